"""Pool files, device images and their index streams as tables."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.codecs import HEADER_BYTES, HEADER_VERSION, decode_entries, decode_header, encode_entry, encode_header, parse_snapshot_meta, snapshot_meta
from ..functions.parse import parse_id
from ..operators.changefeed import entry_kind
from ..types import CAPACITY_UNIT, ENTRY_BYTES, GRID_START, INDEX_BYTES, INDEX_START, SLOT_BYTES

_POOL = "version int, devices array<struct<status:string,device_path:string,disk_id:string,version:int,size_bytes:long>>"
_BLOCK = 4 << 20


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """A pool file: pool_pos, disk_id, device_path, status, version, size_bytes. Ids may be hex (0x) or decimal."""
    d = spark.read.schema(_POOL).option("multiLine", True).json(path).select(F.posexplode("devices").alias("pool_pos", "d"))
    t = F.lower(F.trim("d.disk_id"))
    wide = lambda base: F.conv(F.when(F.lit(base) == 16, F.substring(t, 3, 16)).otherwise(t), base, 10).cast("decimal(20,0)")
    u = F.when(t.startswith("0x"), wide(16)).otherwise(wide(10))
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    signed = F.when(u >= F.lit("9223372036854775808").cast("decimal(20,0)"), u - two64).otherwise(u).cast("long")
    return d.select("pool_pos", signed.alias("disk_id"), "d.device_path", "d.status", "d.version", "d.size_bytes")


def write_pool(pool: DataFrame, path: str) -> None:
    """Writes the catalog as a pool file, in place of the old one at once."""
    import json

    rows = pool.orderBy("pool_pos").collect()  # a catalog of devices
    devices = [{"status": r["status"], "device_path": r["device_path"], "disk_id": f"0x{r['disk_id'] & (2**64 - 1):X}", "version": r["version"], "size_bytes": r["size_bytes"]} for r in rows]
    path = path.removeprefix("file:")
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        json.dump({"version": 1, "devices": devices}, f, indent=2)
    os.replace(tmp, path)


_DEVICES = "device_path string, status string, disk_id long, version int, capacity_gb int, size_bytes long, note string"


#: Names of devices that a folder is searched for, as the first letters of a name.
PREFIXES = ("sd", "nvme", "mmcblk", "vd", "zram")


def device_paths(folder: str, include: tuple[str, ...] = ()) -> list[str]:
    """Paths in a folder whose names begin like a device's or like one of `include`, sorted."""
    return sorted(e.path for e in os.scandir(folder) if e.name.startswith(PREFIXES + tuple(include)) and not e.is_dir())


def find_devices(spark: SparkSession, paths: list[str], include: tuple[str, ...] = ()) -> DataFrame:
    """Images at the paths with status match, no_header or error; only headers are read, in parallel. Folders are searched for device names."""
    paths = [p for given in paths for p in (device_paths(given, include) if os.path.isdir(given) else [given])]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                try:
                    with open(p, "rb") as f:
                        h = decode_header(f.read(HEADER_BYTES))
                    size = os.path.getsize(p)
                    rows.append((p, "match" if h else "no_header", *((h["disk_id"], h["version"], h["capacity_gb"]) if h else (None,) * 3), size, h["note"] if h else None))
                except OSError:
                    rows.append((p, "error", None, None, None, None, None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _DEVICES.split(", ")])
            yield out.astype({"disk_id": "Int64", "version": "Int32", "capacity_gb": "Int32", "size_bytes": "Int64"})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(256, len(paths)))).mapInPandas(probe, _DEVICES)


_ENTRIES = "disk_id long, seq long, fid long, size long, jump_code int"


def read_index(devices: DataFrame) -> DataFrame:
    """index_log rows of the matching devices (device_path, disk_id), seq from 1, up to the first aligned zero entry.

    One task streams one device in blocks of 4 MiB; runs of zero bytes that are not
    aligned do not end a log. An index file (a copy of an image's first part) works too.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, disk in zip(b["device_path"], b["disk_id"], strict=True):
                seq, left = 0, INDEX_BYTES
                with open(path, "rb") as f:
                    f.seek(INDEX_START)
                    while left > 0:
                        data = f.read(min(_BLOCK, left))
                        fid, size, code = decode_entries(data)
                        zero = (fid == 0) & (size == 0) & (code == 0)
                        n = int(zero.argmax()) if zero.any() else len(fid)
                        yield pd.DataFrame({"disk_id": int(disk), "seq": range(seq + 1, seq + n + 1), "fid": fid[:n], "size": size[:n], "jump_code": code[:n]})
                        seq += n
                        left -= len(data)
                        if n < len(fid) or len(data) < _BLOCK:
                            break

    log = devices.where("disk_id is not null").select("device_path", "disk_id").repartition("device_path").mapInPandas(scan, _ENTRIES)
    return log.withColumn("kind", entry_kind(F.col("size"), F.col("jump_code")))


def init_image(path: str, disk_id: int, size_bytes: int, note: str = "", force: bool = False) -> None:
    """A new image with an empty index; refuses one that has a header or entries unless forced."""
    if size_bytes < GRID_START + 4096 or size_bytes // CAPACITY_UNIT > 65535:
        raise ValueError("size out of bounds")
    if os.path.exists(path) and not force:
        with open(path, "rb") as f:
            head = f.read(HEADER_BYTES + 4096)
        if decode_header(head) or any(head[HEADER_BYTES:]):
            raise ValueError("already initialised")
    with open(path, "r+b" if os.path.exists(path) else "w+b") as f:
        f.truncate(size_bytes)
        f.write(encode_header(size_bytes // CAPACITY_UNIT, disk_id, note, HEADER_VERSION))
        f.seek(INDEX_START)
        f.write(bytes(4096))


def write_index(path: str, entries: Iterable[tuple[int, int, int]]) -> None:
    """Writes (fid, size, code) entries and a terminator to an image's index."""
    data = b"".join(encode_entry(*e) for e in entries)
    if len(data) > INDEX_BYTES:
        raise ValueError("index too large")
    with open(path, "r+b") as f:
        f.seek(INDEX_START)
        f.write(data + bytes(min(ENTRY_BYTES, INDEX_BYTES - len(data))))


def write_images(log: DataFrame, folder: str) -> DataFrame:
    """(disk_id, path): a device image with its index for every disk of a log (disk_id, seq, fid, size, code or jump_code).

    One task writes one disk's index, which the format bounds at 16 bytes for each of its
    entries; a larger log is refused.
    """
    code = "code" if "code" in log.columns else "jump_code"

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        disk, n = int(pdf["disk_id"].iloc[0]), len(pdf)
        os.makedirs(folder.removeprefix("file:"), exist_ok=True)
        path = os.path.join(folder.removeprefix("file:"), f"0x{disk & (2**64 - 1):X}")
        init_image(path, disk, GRID_START + 4096 * (n + 1), f"entries {n}", force=True)
        write_index(path, zip(pdf["fid"].tolist(), pdf["size"].tolist(), pdf["code"].tolist(), strict=True))
        return pd.DataFrame({"disk_id": [disk], "path": [path]})

    return log.select("disk_id", "seq", "fid", "size", F.col(code).alias("code")).groupBy("disk_id").applyInPandas(write, "disk_id long, path string")


def write_snapshot(image: str, folder: str, disk_id: int) -> bool:
    """A zstd snapshot of an image with its side file; False if the last one has the same size and hash.

    Written beside, read back and compared, then renamed; the side file comes last.
    """
    import hashlib

    import zstandard

    h, size = hashlib.sha256(), os.path.getsize(image)
    with open(image, "rb") as f:
        while data := f.read(_BLOCK):
            h.update(data)
    target = os.path.join(folder, f"0x{disk_id & (2**64 - 1):X}.zst")
    meta = f"{target}.sha256"
    if os.path.exists(target) and os.path.exists(meta):
        with open(meta) as f:
            if parse_snapshot_meta(f.read()) == (size, h.hexdigest()):
                return False
    os.makedirs(folder, exist_ok=True)
    with open(image, "rb") as src, open(f"{target}.tmp", "wb") as dst:
        zstandard.ZstdCompressor(level=1).copy_stream(src, dst)
    if _unpacked(f"{target}.tmp") != (size, h.hexdigest()):
        os.remove(f"{target}.tmp")
        raise OSError("snapshot differs from its image")
    os.replace(f"{target}.tmp", target)
    with open(f"{meta}.tmp", "w") as f:
        f.write(snapshot_meta(size, h.hexdigest()))
    os.replace(f"{meta}.tmp", meta)
    return True


def _unpacked(path: str) -> tuple[int, str]:
    """(size, sha256) of a snapshot's content."""
    import hashlib

    import zstandard

    h, n = hashlib.sha256(), 0
    with open(path, "rb") as f:
        r = zstandard.ZstdDecompressor().stream_reader(f) if ".zst" in os.path.basename(path) else f
        while data := r.read(_BLOCK):
            h.update(data)
            n += len(data)
    return n, h.hexdigest()


_SNAPSHOTS = "disk_id long, path string, is_zst boolean, size_bytes long, version int, header_id long, meta_size long, meta_sha256 string, sha256 string"


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Every snapshot of a folder as catalog.snapshot_faults() wants it; contents are hashed in parallel.

    Side files and unfinished ones are skipped; so are names that are no disk id.
    """
    import zstandard

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                name = os.path.basename(p)
                packed = name.endswith(".zst")
                with open(p, "rb") as f:
                    head = (zstandard.ZstdDecompressor().stream_reader(f) if packed else f).read(HEADER_BYTES)
                h = decode_header(head) or {}
                meta = (None, None)
                if os.path.exists(f"{p}.sha256"):
                    with open(f"{p}.sha256") as f:
                        meta = parse_snapshot_meta(f.read())
                size, digest = _unpacked(p)
                rows.append((parse_id(name.removesuffix(".zst")), p, packed, size, h.get("version"), h.get("disk_id"), *meta, digest))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _SNAPSHOTS.split(", ")])
            yield out.astype({"header_id": "Int64", "version": "Int32", "meta_size": "Int64"})

    paths = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if not name.endswith((".sha256", ".tmp")):
            try:
                parse_id(name.removesuffix(".zst"))
            except ValueError:
                continue
            paths.append((os.path.join(folder, name),))
    return spark.createDataFrame(paths, "path string").repartition(max(1, min(256, len(paths)))).mapInPandas(probe, _SNAPSHOTS)


def restore_snapshot(path: str, image: str) -> None:
    """Writes a snapshot's content as an image; refuses to touch one that exists."""
    import zstandard

    with open(path, "rb") as src, open(image, "xb") as dst:
        if path.endswith(".zst"):
            zstandard.ZstdDecompressor().copy_stream(src, dst)
        else:
            while data := src.read(_BLOCK):
                dst.write(data)


def pool_state(devices: DataFrame, p: float | None = None) -> DataFrame:
    """The disks of matching images as placement wants them: disk_id, pool_pos, is_zram, faulted, slots, chd.

    A disk whose log a strict replay refuses is faulted. pool_pos is that of the devices,
    or the order of their paths.
    """
    from ..functions.address import slot_count
    from ..functions.parse import is_zram_path
    from ..operators import placement
    from ..operators.indexlog import replay_refs, strict_violations

    pos = F.col("pool_pos") if "pool_pos" in devices.columns else F.row_number().over(W.orderBy("device_path")) - 1
    d = devices.where("status = 'match'").withColumn("slots", slot_count(F.col("size_bytes"))).withColumn("pool_pos", pos)
    log = read_index(d)
    stored = replay_refs(log).where("target_fid = fid").select("disk_id", "fid", F.col("stored_size").alias("size"))
    e = placement.extents(stored.join(d.select("disk_id", "slots"), "disk_id"), F.col("slots")).where("start is not null")
    c = placement.chd(d.select("disk_id", "slots"), e.select("disk_id", "start", "end"), p)
    bad = strict_violations(log).select("disk_id").distinct().withColumn("bad", F.lit(True))
    return d.join(c, "disk_id").join(bad, "disk_id", "left").select("disk_id", "device_path", "pool_pos", is_zram_path(F.col("device_path")).alias("is_zram"), F.coalesce("bad", F.lit(False)).alias("faulted"), "slots", "chd")


def read_objects(devices: DataFrame, objects: DataFrame) -> DataFrame:
    """(disk_id, fid, size, payload) of objects (disk_id, fid, size) from the images of their disks; null where they reach beyond the grid.

    devices: disk_id, device_path, size_bytes. Each task reads the bytes of its objects only.
    """
    from ..functions.address import address, slot_count

    at = objects.join(devices.where("status = 'match'").select("disk_id", "device_path", "size_bytes"), "disk_id")
    at = at.select("disk_id", "device_path", "fid", "size", address(slot_count(F.col("size_bytes")), F.col("fid"), F.col("size"))["addr"].alias("addr"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, n, addr in zip(b["device_path"], b["size"], b["addr"], strict=True):
                data = None
                if pd.notna(addr):
                    with open(path, "rb") as f:
                        f.seek(int(addr))
                        data = f.read(int(n))
                out.append(data if data is not None and len(data) == int(n) else None)
            yield pd.DataFrame({"disk_id": b["disk_id"], "fid": b["fid"], "size": b["size"], "payload": out})

    return at.mapInPandas(read, "disk_id long, fid long, size long, payload binary")


def write_object(path: str, fid: int, payload: bytes) -> None:
    """Writes an object's bytes to its slots in an image, padded with zeros."""
    size = os.path.getsize(path)
    slots, need = max(0, (size - GRID_START) // SLOT_BYTES), -(-len(payload) // SLOT_BYTES)
    if not 0 < need <= slots:
        raise ValueError("the object does not fit")
    with open(path, "r+b") as f:
        f.seek(GRID_START + (fid & (2**64 - 1)) % (slots - need + 1) * SLOT_BYTES)
        f.write(payload.ljust(need * SLOT_BYTES, b"\0"))


def scrub_images(devices: DataFrame, log: DataFrame) -> DataFrame:
    """(disk_id, table_fid, size, reason, head, zero_filled) of every live packed table, read from its image.

    reason: address, short, magic, version, header_size, container_size, length, entry_size,
    entry_range or disk_id, the first rule that its bytes break; null if it is sound. head:
    its first 16 bytes in hex; zero_filled: whether they are all zero.
    """
    from ..functions.codecs import packed_udf
    from ..operators.changefeed import latest_records

    tables = latest_records(log).where("packed").select("disk_id", "fid", F.col("actual_size").alias("size"))
    x = read_objects(devices, tables).withColumn("p", packed_udf("payload"))
    reason = F.when(F.col("payload").isNull(), "address").when(F.col("p.fault").isNotNull(), F.col("p.fault")).when(F.col("p.disk_id") != F.col("disk_id"), "disk_id")
    head = F.substring(F.hex("payload"), 1, 32)
    return x.select("disk_id", F.col("fid").alias("table_fid"), "size", reason.alias("reason"), head.alias("head"), F.coalesce(head.rlike("^0*$"), F.lit(False)).alias("zero_filled"))


def rewrite_index(spark: SparkSession, devices: DataFrame, log: DataFrame, backup: str | None = None) -> None:
    """Writes a compacted log into its images, after a backup of what they have and a check of what is written.

    devices: those of the log's disks, a catalog. A log that breaks a rule of compacted logs is refused.
    """
    from ..operators import indexlog

    new = indexlog.compacted(log)
    if backup:
        indexlog.backup(read_index(devices).drop("kind"), backup)
    for r in devices.where("status = 'match'").select("disk_id", "device_path").collect():
        rows = new.where(F.col("disk_id") == r["disk_id"]).orderBy("seq").select("fid", "size", "jump_code").toLocalIterator()
        write_index(r["device_path"], [(x["fid"], x["size"], x["jump_code"]) for x in rows])

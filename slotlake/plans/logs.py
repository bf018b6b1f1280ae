"""Queries of replayed logs, trim steps and index images, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, changefeed, indexlog, placement, trim
from ..session import broadcast_if_small, cut, delete_at_end, shared_dir
from ..sources import images
from ..sources.tables import table
from .formats import _DEVICES_SQL, _devices
from .general import _LOG_SQL
from .pool import POOL_SLOTS, _room
from .store import _ELIGIBLE_SQL, _KINDS_SQL, _U, DISK_SLOTS, _batch, _log, query

_REFS_SQL = f"""
{_LOG_SQL},
ev AS (SELECT disk_id, fid, pos, put, size, actual_fid, actual_size, packed FROM acts UNION ALL SELECT disk_id, actual_fid, pos, TRUE, actual_size, actual_fid, actual_size, packed FROM acts WHERE put AND jump),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disk_id, fid ORDER BY pos DESC, size DESC) AS k FROM ev) WHERE k = 1 AND put),
pent AS (SELECT DISTINCT disk_id, table_fid, container_fid, container_size, unnest(entries) AS e FROM packed),
ins AS (SELECT p.disk_id, e.fid AS fid, container_fid, e.byte_offset AS byte_offset, e.size AS size, row_number() OVER (PARTITION BY p.disk_id, e.fid ORDER BY container_fid DESC, e.byte_offset DESC, e.size DESC) AS k
  FROM pent p JOIN lst t ON t.packed AND t.disk_id = p.disk_id AND t.fid = p.table_fid WHERE e.size > 0 AND e.byte_offset + e.size <= container_size),
box AS (SELECT disk_id, container_fid, max(container_size) AS stored_size FROM packed GROUP BY ALL),
inside AS (SELECT i.disk_id, i.fid, i.container_fid, b.stored_size, i.size, i.byte_offset FROM ins i JOIN box b ON b.disk_id = i.disk_id AND b.container_fid = i.container_fid WHERE k = 1),
rep AS (SELECT disk_id, fid, actual_fid AS target_fid, actual_size AS stored_size, size, CAST(0 AS BIGINT) AS byte_offset, FALSE AS packed FROM lst l
    WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.disk_id = l.disk_id AND i.fid = l.fid)
  UNION ALL SELECT disk_id, fid, container_fid, stored_size, size, byte_offset, TRUE FROM inside)
"""


@query(f"WITH {_REFS_SQL} SELECT * FROM rep")
def replayed_refs(s, d):
    """What a restart has in memory: every fid's place, packed objects in their containers."""
    return indexlog.replay_refs(_log(s, d), table(s, d, "packed"))


@query(
    f"""WITH {_REFS_SQL},
spots AS (SELECT disk_id, fid, CAST(ceil(actual_size / 4096.0) AS BIGINT) AS need, {_U('fid')} AS u FROM lst WHERE actual_fid = fid AND actual_size > 0 AND ceil(actual_size / 4096.0) <= {DISK_SLOTS}),
ext AS (SELECT disk_id, fid, CAST(u % CAST({DISK_SLOTS} - need + 1 AS UBIGINT) AS BIGINT) AS a, need FROM spots),
reach AS (SELECT *, max(a + need - 1) OVER (PARTITION BY disk_id ORDER BY a, a + need - 1, fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ext),
snd AS (SELECT disk_id, table_fid, bool_and(coalesce(container_size, 0) > 0 AND len(list_filter(coalesce(entries, []), lambda e: coalesce(e.size <= 0 OR e.byte_offset + e.size > container_size, TRUE))) = 0) AS ok FROM packed GROUP BY ALL)
SELECT 'overlap' AS rule, disk_id, fid FROM reach WHERE a <= b
UNION ALL SELECT 'packed_table', l.disk_id, l.fid FROM last l LEFT JOIN snd ON snd.disk_id = l.disk_id AND snd.table_fid = l.fid WHERE l.packed AND NOT coalesce(ok, FALSE)"""
)
def replay_refusals(s, d):
    return indexlog.replay_refusals(_log(s, d), table(s, d, "packed"), F.lit(DISK_SLOTS).cast("long"))


@query(f"WITH {_LOG_SQL} SELECT disk_id, fid, size, actual_fid, actual_size, jump, packed FROM last")
def compacted_replay(s, d):
    """The records of the compacted and validated log: those of the log itself."""
    return changefeed.latest_records(indexlog.compacted(_log(s, d))).select("disk_id", "fid", "size", "actual_fid", "actual_size", "jump", "packed")


@query(f"WITH {_KINDS_SQL} SELECT disk_id, seq, fid, size, code AS jump_code FROM k")
def restored_logs(s, d):
    """All logs from a backup, up to their ends."""
    folder = f"{shared_dir(s)}/backup-{uuid.uuid4().hex}"
    delete_at_end(s, folder)
    indexlog.backup(indexlog.with_kind(_log(s, d)).select("disk_id", "seq", "fid", "size", F.col("code").alias("jump_code")), folder)
    parts = [indexlog.restore(s, folder, r["disk_id"]) for r in table(s, d, "index_log").select("disk_id").distinct().collect()]  # a catalog of disks
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("disk_id", "seq", "fid", "size", "jump_code")


def _images(s: SparkSession, d: str) -> DataFrame:
    """Device images of all disks with a log, as find_devices() sees them."""
    folder = f"{shared_dir(s)}/images-{uuid.uuid4().hex}"
    delete_at_end(s, folder)
    return images.find_devices(s, [r["path"] for r in images.write_images(indexlog.with_kind(_log(s, d)), folder).collect()])


@query(f"WITH {_KINDS_SQL} SELECT disk_id, seq, fid, size, code AS jump_code, kind FROM (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY seq) AS n FROM k) WHERE n <= 16776960")
def image_logs(s, d):
    """The logs of all disks, written to device images and read from them."""
    return images.read_index(_images(s, d)).select("disk_id", "seq", "fid", "size", "jump_code", "kind")


@query(f"WITH {_KINDS_SQL} SELECT disk_id, 'match' AS status, CAST(2 AS INT) AS version, CAST((count(*) * 4096 + 268439552) // 1000000000 AS INT) AS capacity_gb, count(*) * 4096 + 268435456 + 4096 AS size_bytes, 'entries ' || count(*) AS note FROM k GROUP BY disk_id UNION ALL SELECT NULL, 'error', NULL, NULL, NULL, NULL")
def image_devices(s, d):
    """The devices found: every image, and a path without one."""
    found = _images(s, d)
    lost = images.find_devices(s, ["/nowhere/sd0"])
    return found.unionByName(lost).select("disk_id", "status", "version", "capacity_gb", "size_bytes", "note")


@query(f"WITH {_DEVICES_SQL} SELECT disk_id, device_path, CAST(row_number() OVER (ORDER BY disk_id) - 1 AS INT) AS pool_pos, CAST(coalesce(n, 0) AS BIGINT) AS size_bytes FROM dev")
def pool_file(s, d):
    """The pool as its file tells it, written and read."""
    x = _devices(s, d).select("disk_id", "device_path", F.lit("match").alias("status"), F.lit(2).alias("version"), F.coalesce("n", F.lit(0)).alias("size_bytes")).withColumn("pool_pos", F.col("disk_id"))
    path = f"{shared_dir(s)}/pool-{uuid.uuid4().hex}.json"
    delete_at_end(s, path)
    images.write_pool(x, path)
    return images.read_pool(s, path).select("disk_id", "device_path", "pool_pos", "size_bytes")


@query(
    f"""WITH {_DEVICES_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY device_path, disk_id) AS k FROM dev)
SELECT 'first' AS asked, disk_id FROM o WHERE k = 1 UNION ALL SELECT 'by id', disk_id FROM dev WHERE disk_id = (SELECT max(disk_id) FROM dev)"""
)
def selected_device(s, d):
    """The pool's first device, and the one of a given id."""
    x = _devices(s, d)
    pool = x.withColumn("pool_pos", F.struct("device_path", "disk_id"))
    top = x.agg(F.max("disk_id")).first()[0]
    return catalog.select_device(pool).select(F.lit("first").alias("asked"), "disk_id").unionByName(catalog.select_device(pool, f"0x{top & (2**64 - 1):x}").select(F.lit("by id").alias("asked"), "disk_id"))


@query(f"WITH {_LOG_SQL}, {_ELIGIBLE_SQL} SELECT disk_id, fid, CAST(0 AS BIGINT) AS size, 0 AS jump_code FROM laid WHERE byte_offset + size <= 8388608 OR byte_offset = 0")
def trim_tombstones(s, d):
    """The log rows that delete what one trim pass packs."""
    return trim.tombstones(_batch(s, d))


@query(
    """WITH e AS (SELECT disk_id, unnest(entries) AS e, container_size FROM packed), v AS (SELECT disk_id, e.fid AS fid, min(e.size) AS size FROM e WHERE e.size > 0 AND e.byte_offset + e.size <= container_size GROUP BY ALL),
c AS (SELECT disk_id, fid, min(coalesce(size, stored_size)) AS size FROM refs WHERE packed GROUP BY ALL)
SELECT c.disk_id, c.fid, CASE WHEN v.fid IS NULL THEN 'missing' ELSE 'size' END AS fault FROM c LEFT JOIN v ON v.disk_id = c.disk_id AND v.fid = c.fid WHERE v.fid IS NULL OR v.size <> c.size"""
)
def trim_verified(s, d):
    """Refs said to be packed that the packed tables do not carry, or carry with another size."""
    from ..operators.consolidate import valid_entries

    none = F.lit(None).cast("string").alias("digest")
    e = valid_entries(table(s, d, "packed")).groupBy("disk_id", "fid").agg(F.min("size").alias("size")).select("disk_id", "fid", "size", none)
    c = table(s, d, "refs").where("packed").groupBy("disk_id", "fid").agg(F.min(F.coalesce("size", "stored_size")).alias("size")).select("disk_id", "fid", "size", none)
    return trim.verify(e, c)


def _limits_sql() -> str:
    from .pool import _chd_sql, _extents_sql

    return f"WITH RECURSIVE {_extents_sql(POOL_SLOTS)}, {_chd_sql(POOL_SLOTS)} SELECT disk_id, least(greatest(least(chd, 268435456), 8388608), 268435456) AS bytes FROM room"


@query(_limits_sql())
def trim_limits(s, d):
    """Bytes that one trim pass may pack on each disk, by its room."""
    return _room(s, d, POOL_SLOTS).select("disk_id", trim.batch_limit(F.col("chd"), 256 << 20).alias("bytes"))


def _payloads(s: SparkSession, d: str) -> DataFrame:
    """An object's bytes for every record: its fid in hex, over and over, up to its size."""
    r = changefeed.latest_records(_log(s, d)).join(broadcast_if_small(catalog_thresholds(s, d)), "disk_id").where("size < threshold and size > 0").select("fid", "size").distinct()
    h = F.lpad(F.hex("fid"), 16, "0")
    return r.select("fid", F.substring(F.repeat(h, F.ceil(F.col("size") / 16).cast("int")), F.lit(1), F.col("size").cast("int")).cast("binary").alias("payload"))


def catalog_thresholds(s: SparkSession, d: str) -> DataFrame:
    from ..operators.consolidate import latest_thresholds

    return latest_thresholds(table(s, d, "trim_status")).select("disk_id", "threshold")


@query(
    f"""WITH {_LOG_SQL}, {_ELIGIBLE_SQL}, tot AS (SELECT e.disk_id, count(*) AS n, count(*) FILTER (WHERE e.size < l.threshold) AS m FROM eli e JOIN lim l ON e.disk_id = l.disk_id GROUP BY ALL),
clash AS (SELECT fid FROM (SELECT DISTINCT fid, size FROM last l JOIN lim USING (disk_id) WHERE l.size < threshold AND l.size > 0) GROUP BY fid HAVING count(*) > 1)
SELECT b.disk_id, count(*) AS packed, CAST(sum(size) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS refused FROM laid b JOIN tot USING (disk_id) WHERE m > 100 AND m > n * 0.2 AND (byte_offset + size <= 8388608 OR byte_offset = 0) GROUP BY b.disk_id"""
)
def trim_cycle(s, d):
    """One trim pass over all disks: objects packed, their bytes, those not read back rightly from the replayed log, and rules the new log breaks."""
    from ..operators import reads

    log, limits = _log(s, d), catalog_thresholds(s, d)
    payloads = cut(_payloads(s, d))
    rows, tables, boxes = trim.cycle(log, table(s, d, "packed"), limits, payloads, slots=DISK_SLOTS)
    before = log.select("disk_id", "seq", "fid", "size", "jump_code")
    ended = indexlog.with_kind(log).select("disk_id", "seq", "fid", "size", F.col("code").alias("jump_code"))
    after = cut(ended.unionByName(rows.select(*before.columns)))
    new = tables.select("table_fid", "disk_id", "container_fid", "container_size", "nonce", "entries")
    refs = indexlog.replay_refs(after, table(s, d, "packed").unionByName(new)).where("packed").join(new.select("disk_id", F.col("container_fid").alias("target_fid")), ["disk_id", "target_fid"], "left_semi")
    data = reads.resolve(refs, boxes.select("fid", "payload"))
    packed = new.select("disk_id", F.inline("entries").alias("fid", "byte_offset", "size"))
    back = packed.join(data, ["disk_id", "fid"], "left").join(payloads, "fid")
    lost = F.count_if(~F.col("data").eqNullSafe(F.col("payload")))
    out = back.groupBy("disk_id").agg(F.count(F.lit(1)).alias("packed"), F.sum("size").alias("bytes"), lost.alias("lost"))
    bad = indexlog.validate_compacted(indexlog.compact_entries(after)).groupBy("disk_id").agg(F.count(F.lit(1)).alias("refused"))
    return out.join(bad, "disk_id", "left").select("disk_id", "packed", "bytes", "lost", F.coalesce("refused", F.lit(0)).alias("refused"))

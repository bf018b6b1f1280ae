"""Fragmentation, eligibility, batching and packing of small objects (the trim cycle as data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.address import floor_log2
from ..types import TRIM_BATCH, TRIM_MAX_THRESHOLD, TRIM_MIN_FILES, TRIM_MIN_THRESHOLD, TRIM_RATIO
from . import placement
from .prefix import blocked_running_sum

#: seq values per block of the running sums.
SEQ_BLOCK = 1 << 16


def histogram(sizes: DataFrame, group: list[str]) -> DataFrame:
    """(group, pow, upper, files, from_top): files by floor(log2(size)), every power from 0 to the largest.

    Zero, negative and null sizes are skipped. from_top counts the files of this power and
    all larger. A group has at most 63 powers.
    """
    h = sizes.where("size > 0").groupBy(*group, floor_log2(F.col("size")).alias("pow")).agg(F.count(F.lit(1)).alias("files"))
    top = h.groupBy(*group).agg(F.max("pow").alias("top"))
    grid = top.select(*group, F.explode(F.sequence(F.lit(0), F.col("top"))).alias("pow"))
    x = grid.join(h, [*group, "pow"], "left").withColumn("files", F.coalesce("files", F.lit(0).cast("long")))
    w = W.partitionBy(*group).orderBy(F.col("pow").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return x.select(*group, "pow", F.pow(F.lit(2.0), F.col("pow") + 1).cast("long").alias("upper"), "files", F.sum("files").over(w).alias("from_top"))


def fragmentation_threshold(sizes: DataFrame, group: list[str]) -> DataFrame:
    """(group, threshold): the upper bound of the most populous power, the lowest one on ties."""
    h = sizes.where("size > 0").groupBy(*group, floor_log2(F.col("size")).alias("pow")).agg(F.count(F.lit(1)).alias("files"))
    best = F.max(F.struct("files", (-F.col("pow")).alias("low")))
    return h.groupBy(*group).agg(best.alias("b")).select(*group, F.pow(F.lit(2.0), 1 - F.col("b.low")).cast("long").alias("threshold"))


def clamp(threshold: Column, least: int = TRIM_MIN_THRESHOLD, most: int = TRIM_MAX_THRESHOLD) -> Column:
    t = F.greatest(threshold, F.lit(least))
    return F.least(t, F.lit(most)) if most > 0 else t


def eligible(records: DataFrame, packed: DataFrame) -> DataFrame:
    """The latest records that may be packed: no packed tables, containers, jump pointers or jump targets."""
    targets = records.where("jump").select("disk_id", F.col("actual_fid").alias("fid"))
    containers = packed.select("disk_id", F.col("container_fid").alias("fid")).unionByName(packed.select("disk_id", F.col("table_fid").alias("fid")))
    out = targets.unionByName(containers).distinct()
    return records.where("not jump and not packed").join(out, ["disk_id", "fid"], "left_anti")


def trigger(eligible_: DataFrame, thresholds: DataFrame, least_files: int = TRIM_MIN_FILES, ratio: float = TRIM_RATIO) -> DataFrame:
    """(disk_id, threshold, total_files, small_files, fires): whether a disk's small files are too many; both bounds strict."""
    x = eligible_.join(thresholds, "disk_id")
    g = x.groupBy("disk_id", "threshold").agg(F.count(F.lit(1)).alias("total_files"), F.count_if(F.col("size") < F.col("threshold")).alias("small_files"))
    return g.withColumn("fires", (F.col("small_files") > least_files) & (F.col("small_files") > F.col("total_files") * ratio))


def batch_limit(chd: Column, max_put: int) -> Column:
    return F.least(F.greatest(F.least(chd, F.lit(TRIM_BATCH[1])), F.lit(TRIM_BATCH[0])), F.lit(max_put))


def batch(small: DataFrame, limit: int, group: list[str], block: int = SEQ_BLOCK) -> DataFrame:
    """The prefix in seq order that fits in `limit` bytes, the first always; adds byte_offset.

    Sizes above 0 make the running sum rise, so the rows before the first that exceeds the
    limit are those whose sum stays within it. Sums run in blocks of seq.
    """
    x = blocked_running_sum(small.where("size > 0"), group, F.floor(F.col("seq") / block), [F.col("seq")], "size", "byte_offset")
    return x.where((F.col("byte_offset") + F.col("size") <= limit) | (F.col("byte_offset") == 0))


def containers(objects: DataFrame, group: list[str]) -> DataFrame:
    """(group, container_size, payload, entries) of batched objects (seq, fid, size, byte_offset, payload).

    A batch is bounded by its byte limit, and with it the row made here.
    """
    rows = F.sort_array(F.collect_list(F.struct("seq", "fid", "byte_offset", "size", "payload")))
    g = objects.groupBy(*group).agg(rows.alias("r"))
    glue = F.aggregate("r", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["payload"]))
    return g.select(
        *group, F.aggregate("r", F.lit(0).cast("long"), lambda acc, x: acc + x["size"]).alias("container_size"), glue.alias("payload"), F.transform("r", lambda x: F.struct(x["fid"].alias("fid"), x["byte_offset"].alias("byte_offset"), x["size"].alias("size"))).alias("entries")
    )


def verify(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(disk_id, fid, fault) of candidates that an expanded table does not carry rightly: missing, size or content.

    entries and candidates: disk_id, fid, size, digest. Contents are compared, not only lengths.
    """
    e = entries.select("disk_id", "fid", F.col("size").alias("s"), F.col("digest").alias("d"))
    x = candidates.join(e, ["disk_id", "fid"], "left")
    fault = F.when(F.col("s").isNull(), "missing").when(F.col("s") != F.col("size"), "size").when(~F.col("d").eqNullSafe(F.col("digest")), "content")
    return x.select("disk_id", "fid", fault.alias("fault")).where("fault is not null")


def tombstones(candidates: DataFrame) -> DataFrame:
    """The log rows that delete the packed objects."""
    return candidates.select("disk_id", "fid", F.lit(0).cast("long").alias("size"), F.lit(0).alias("jump_code"))


def free_nonce(candidates: DataFrame, known: DataFrame, taken: DataFrame, slots: int) -> DataFrame:
    """(disk_id, nonce, fid): each disk's first candidate (nonce, fid, size) whose fid is new there and whose extent is free.

    A disk whose candidates are all in conflict has no row. known: disk_id, fid; taken:
    disk_id, start, end. Candidates are few: one container or table for each disk, with
    at most 256 nonces.
    """
    new = placement.extents(candidates.join(known.select("disk_id", "fid").distinct(), ["disk_id", "fid"], "left_anti"), F.lit(slots).cast("long")).where("start is not null")
    free = placement.free_of(new, taken, ["disk_id"])
    return free.groupBy("disk_id").agg(F.min(F.struct("nonce", "fid")).alias("r")).select("disk_id", "r.nonce", "r.fid")


def cycle(log: DataFrame, packed: DataFrame, thresholds: DataFrame, payloads: DataFrame, limit: int = TRIM_BATCH[0], least_files: int = TRIM_MIN_FILES, ratio: float = TRIM_RATIO, slots: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One trim pass over all disks: (new log rows, new packed tables, containers with payload).

    Disks whose small files are too many get one container of at most `limit` bytes: the
    new rows publish the container, its table behind an anchor, and a tombstone for each
    object packed, numbered behind the log's end in this order, so that a log cut
    anywhere still reads every object. With `slots`, container and table must find their
    fid new on the disk and their slots free: a container in conflict gets counters
    appended, a table another nonce, up to 256 times; a disk without a free place is left
    alone. The tables are read back from their bytes and held against the objects (size
    and digest) before anything is given out; a disk where they differ is left alone.
    payloads: fid, payload. A disk with an object whose bytes are missing or of another
    length is left alone, too. Rewrite the log with indexlog.compacted() afterwards.
    """
    from ..functions.codecs import NONCE_AT, encode_packed, packed_udf
    from ..functions.fid import NONCES, container_fids, content_fid
    from ..session import cut
    from .changefeed import latest_records
    from .indexlog import anchor_rows, replay_refs, with_kind

    # Lineage is cut where a result feeds several others, or plans would double at each step.
    log = cut(log)
    all_ = cut(eligible(latest_records(log), packed))
    fires = trigger(all_, thresholds, least_files, ratio).where("fires").select("disk_id", "threshold")
    small = all_.join(fires, "disk_id").where("size < threshold").select("disk_id", "fid", "seq", "size")
    chosen = batch(small, limit, ["disk_id"]).select("disk_id", "fid", "seq", "size", "byte_offset")
    full = cut(chosen.join(payloads.dropDuplicates(["fid"]), "fid", "left"))
    broken = full.where("payload is null or octet_length(payload) != size").select("disk_id").distinct()
    boxes = cut(containers(full.join(broken, "disk_id", "left_anti"), ["disk_id"]))
    refs = cut(replay_refs(log, packed))
    taken = placement.extents(refs.where("target_fid = fid").select("disk_id", "fid", F.col("stored_size").alias("size")), F.lit(slots or 1).cast("long")).where("start is not null")

    def placed(candidates: DataFrame) -> DataFrame:
        if slots is None:
            return candidates.where("nonce = 0").select("disk_id", "nonce", "fid")
        return free_nonce(candidates, refs, taken, slots)

    tries = boxes.select("disk_id", F.posexplode(container_fids("payload")).alias("nonce", "fid"), "container_size").select("disk_id", "nonce", "fid", (F.col("container_size") + 8 * F.col("nonce")).alias("size"))
    place = cut(placed(tries)).select("disk_id", F.col("nonce").alias("tail"), F.col("fid").alias("container_fid"))
    counters = F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.col("tail")), lambda k: F.concat(F.lpad(F.hex(k.bitwiseAND(F.lit(255))), 2, "0"), F.lit("00000000000000")))))
    longer = F.when(F.col("tail") > 0, F.concat("payload", counters)).otherwise(F.col("payload"))
    boxes = boxes.join(place, "disk_id").withColumn("payload", longer).withColumn("container_size", F.octet_length("payload").cast("long"))

    @F.udf("array<struct<nonce:int,fid:long,size:long>>")
    def table_fids(disk, fid, size, entries):
        rows = [(e["fid"], e["byte_offset"], e["size"]) for e in entries]
        blob = bytearray(encode_packed(disk, fid, size, rows))
        out = []
        for n in range(NONCES if slots is not None else 1):
            blob[NONCE_AT : NONCE_AT + 8] = n.to_bytes(8, "little")
            out.append((n, content_fid(blob), len(blob)))
        return out

    @F.udf("binary")
    def table(disk, fid, size, entries, nonce):
        return bytearray(encode_packed(disk, fid, size, [(e["fid"], e["byte_offset"], e["size"]) for e in entries], nonce))

    boxes = cut(boxes)
    if slots is not None:
        own = placement.extents(boxes.select("disk_id", F.col("container_fid").alias("fid"), F.col("container_size").alias("size")), F.lit(slots).cast("long"))
        taken = cut(taken.select("disk_id", "start", "end").unionByName(own.select("disk_id", "start", "end")))
    tries = boxes.select("disk_id", F.inline(table_fids("disk_id", "container_fid", "container_size", "entries")))
    place = placed(tries).select("disk_id", "nonce", F.col("fid").alias("table_fid"))
    boxes = cut(boxes.join(place, "disk_id").withColumn("table", table("disk_id", "container_fid", "container_size", "entries", "nonce")))
    # What the table and the container give back must be what was packed.
    read = boxes.select("disk_id", "container_fid", "payload", packed_udf("table").alias("p")).where("p.fault is null and p.disk_id = disk_id and p.container_fid = container_fid")
    entries = read.select("disk_id", "payload", F.inline("p.entries")).select("disk_id", "fid", "size", F.md5(F.substring(F.col("payload"), (F.col("byte_offset") + 1).cast("int"), F.col("size").cast("int"))).alias("digest"))
    wrong = verify(entries, full.join(boxes.select("disk_id"), "disk_id", "left_semi").select("disk_id", "fid", "size", F.md5("payload").alias("digest"))).select("disk_id").distinct()
    ends = with_kind(log).groupBy("disk_id").agg(F.max("seq").alias("last"))
    boxes = cut(boxes.join(wrong, "disk_id", "left_anti").join(ends, "disk_id"))
    plain = boxes.select("disk_id", "last", F.inline(F.array(F.struct(F.lit(1).alias("at"), F.col("container_fid").alias("fid"), F.col("container_size").alias("size")), F.struct(F.lit(2).alias("at"), F.col("table_fid").alias("fid"), F.octet_length("table").cast("long").alias("size")))))
    rows = plain.select("disk_id", (F.col("last") + F.col("at")).alias("seq"), "fid", "size", F.lit(0).alias("jump_code"))
    anchors = anchor_rows(boxes.select("disk_id", F.col("table_fid").alias("fid"), F.octet_length("table").cast("long").alias("size"))).join(boxes.select("disk_id", "last"), "disk_id")
    rows = rows.unionByName(anchors.select("disk_id", (F.col("last") + 3 + F.col("sub")).alias("seq"), "fid", "size", "jump_code"))
    dead = boxes.select("disk_id", "last", F.posexplode("entries").alias("n", "e")).select("disk_id", (F.col("last") + 5 + F.col("n")).alias("seq"), F.col("e.fid").alias("fid"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("jump_code"))
    tables = boxes.select("table_fid", "disk_id", "container_fid", "container_size", F.col("nonce").cast("long").alias("nonce"), "entries", "table")
    return rows.unionByName(dead), tables, boxes.select("disk_id", F.col("container_fid").alias("fid"), F.col("container_size").alias("size"), "payload")

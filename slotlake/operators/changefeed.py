"""Replay of a change feed: inserts, updates and deletes in commit order.

Rows of an index log are (disk_id, seq, fid, size, jump_code, kind). A change is one
row (plain, tombstone) or a pair of adjacent rows (a jump or anchor indicator and the
row it opens for). The replay assembles the pairs, drops repeated deliveries, holds
back what lies behind a gap in seq when the log is still growing, and keeps the
latest change of every key.

Work is split by (disk, block of seq), never by disk alone: whether a pair is open at
the first row of a block follows from one summary row per block. Nonconflicting keys
are then reduced in parallel, with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..types import ANCHOR_CODE, JUMP_SENTINEL, PACKED_SENTINEL

#: Sequence numbers per block, as a power of two. A block is the unit of one window partition.
BLOCK_BITS = 16


def indicator(size: Column, code: Column) -> Column:
    return ((code != 0) & (size == JUMP_SENTINEL)) | ((code == ANCHOR_CODE) & (size == PACKED_SENTINEL))


def entry_kind(size: Column, code: Column) -> Column:
    """plain, tombstone, jump, anchor or stray, as size and jump_code tell it."""
    return (
        F.when((code == ANCHOR_CODE) & (size == PACKED_SENTINEL), "anchor")
        .when((code != 0) & (size == JUMP_SENTINEL), "jump")
        .when(code != 0, "stray")
        .when(size == 0, "tombstone")
        .otherwise("plain")
    )


def ordered_entries(log: DataFrame) -> DataFrame:
    """One row (disk_id, seq, fid, size, code) for each sequence number of each disk.

    Redelivered rows collapse before the shuffle. Rows without disk_id or seq have no
    place in the order and are left out. A null size or jump_code is read from kind;
    what stays unreadable (also a null fid) becomes a stray entry: size -1, code 1,
    which closes an open pair without effect. If copies differ, the least whole row counts.
    """
    kind = F.col("kind") if "kind" in log.columns else F.lit(None).cast("string")
    size = F.coalesce(F.col("size"), F.when(kind == "tombstone", 0).when(kind == "jump", JUMP_SENTINEL).when(kind == "anchor", PACKED_SENTINEL))
    code = F.coalesce(F.col("jump_code"), F.when(kind.isin("plain", "tombstone"), 0).when(kind == "jump", 1).when(kind == "anchor", ANCHOR_CODE))
    bad = size.isNull() | code.isNull() | F.col("fid").isNull()
    rows = log.where(F.col("disk_id").isNotNull() & F.col("seq").isNotNull()).select(
        "disk_id", "seq", F.coalesce("fid", F.lit(0)).alias("fid"), F.when(bad, -1).otherwise(size).cast("long").alias("size"), F.when(bad, 1).otherwise(code).cast("int").alias("code")
    )
    return rows.groupBy("disk_id", "seq").agg(F.min(F.struct("fid", "size", "code")).alias("r")).select("disk_id", "seq", "r.*")


def _blocks(entries: DataFrame, block_bits: int) -> DataFrame:
    w = W.partitionBy("disk_id", "block").orderBy("seq")
    # One shuffle for the rows and for the edges: the same columns, no filter on the block.
    blocked = entries.withColumn("block", F.coalesce(F.shiftright("seq", block_bits), F.lit(0).cast("long"))).repartition("disk_id", "block")
    return blocked.select(
        "*",
        indicator(F.col("size"), F.col("code")).alias("ind"),
        F.row_number().over(w).alias("rn"),
        F.lag(F.struct("seq", "fid", "code", "size")).over(w).alias("prev"),
    )


def _edges(rows: DataFrame) -> DataFrame:
    """What every block has to know of the blocks before it: one row per (disk, block)."""
    gap = (F.col("rn") > 1) & (F.col("seq") != F.col("prev.seq") + 1)
    terminator = (F.col("fid") == 0) & (F.col("size") == 0) & (F.col("code") == 0)
    sums = rows.groupBy("disk_id", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(~F.col("ind"), F.col("rn"))).alias("last_other"),
        F.max(F.struct("seq", "fid", "code", "size")).alias("last_row"),
        F.min("seq").alias("first_seq"),
        F.min(F.when(terminator, F.col("seq"))).alias("end_here"),
        F.min(F.when(gap, F.struct("seq", F.col("prev.seq").alias("prev_seq")))).alias("gap_here"),
    )
    d = W.partitionBy("disk_id").orderBy("block")
    upto, before = d.rowsBetween(W.unboundedPreceding, W.currentRow), d.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("disk_id")
    # A block of indicators only passes an open pair on; any other block resets it.
    flips = F.when(F.col("last_other").isNull(), F.col("n")).otherwise(0)
    step = sums.withColumn("flips", F.sum(flips).over(upto))
    step = step.withColumn("reset", F.when(F.col("last_other").isNotNull(), F.col("n") - F.col("last_other") - F.col("flips")))
    step = step.select(
        "*",
        F.lag("flips", 1, 0).over(d).alias("flips_before"),
        F.last("reset", ignorenulls=True).over(before).alias("reset_before"),
        F.lag("last_row").over(d).alias("row_before"),
    )
    edge_gap = F.col("row_before").isNotNull() & (F.col("first_seq") != F.col("row_before.seq") + 1)
    step = step.withColumn("gap_here", F.when(edge_gap, F.struct(F.col("first_seq").alias("seq"), F.col("row_before.seq").alias("prev_seq"))).otherwise(F.col("gap_here")))
    step = step.withColumn("gap", F.min("gap_here").over(whole))
    return step.select(
        "disk_id",
        "block",
        "n",
        "first_seq",
        "last_row",
        "row_before",
        F.pmod(F.col("flips_before") + F.coalesce("reset_before", F.lit(0)), F.lit(2)).alias("carry"),
        F.min("end_here").over(whole).alias("end_seq"),
        F.col("gap.seq").alias("gap_seq"),
        F.col("gap.prev_seq").alias("gap_prev"),
        F.min("first_seq").over(whole).alias("log_start"),
    )


def committed_changes(log: DataFrame, sealed: bool = True, first_seq: int = 1, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Every complete change, in the state of the log that may be seen.

    Columns disk_id, pos (the row that completed the change), op (put, delete or
    stray), fid, seq, size, actual_fid, actual_size, jump_code, jump, packed.

    sealed: the log is whole, so missing sequence numbers never come and the rows next
    to each other are adjacent. Otherwise rows from the first gap on are held back,
    also all rows of a disk whose log does not begin at first_seq.
    The first row with fid, size and jump_code 0 ends a disk's log.
    """
    rows = _blocks(ordered_entries(log), block_bits)
    joined = rows.join(_edges(rows).select("disk_id", "block", "row_before", "carry", "end_seq", "gap_seq", "log_start"), ["disk_id", "block"])
    w = W.partitionBy("disk_id", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last_other = F.max(F.when(~F.col("ind"), F.col("rn"))).over(w)
    run = F.col("rn") - 1 - F.coalesce(F.col("last_other"), F.lit(0)) + F.when(F.col("last_other").isNull(), F.col("carry")).otherwise(0)
    seen = F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))
    if not sealed:
        seen &= (F.col("gap_seq").isNull() | (F.col("seq") < F.col("gap_seq"))) & (F.col("log_start") == first_seq)
    x = joined.withColumn("last_other", last_other).withColumn("open", F.pmod(run, F.lit(2)) == 1).where(seen)
    x = x.withColumn("head", F.when(F.col("rn") == 1, F.col("row_before")).otherwise(F.col("prev")))
    completes = F.col("open") & (F.col("code") == 0) & (F.col("size") != 0)
    kind = entry_kind(F.col("size"), F.col("code"))
    packed = completes & (F.col("head.code") == ANCHOR_CODE) & (F.col("head.size") == PACKED_SENTINEL)
    op = F.when(completes, "put").when(F.col("open"), None).when(F.col("ind"), None).when(kind == "tombstone", "delete").when(kind == "stray", "stray").otherwise("put")
    jump = completes & ~packed
    return x.select(
        "disk_id",
        F.col("seq").alias("pos"),
        op.alias("op"),
        F.when(completes, F.col("head.fid")).otherwise(F.col("fid")).alias("fid"),
        F.when(completes, F.col("head.seq")).otherwise(F.col("seq")).alias("seq"),
        F.when(jump, F.col("size") - 1).otherwise(F.col("size")).alias("size"),
        F.col("fid").alias("actual_fid"),
        F.col("size").alias("actual_size"),
        F.when(completes, F.col("head.code")).otherwise(F.lit(0)).alias("jump_code"),
        jump.alias("jump"),
        packed.alias("packed"),
    ).where(F.col("op").isNotNull())


def latest_records(log: DataFrame, sealed: bool = True, first_seq: int = 1, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The record of every fid on every disk after all visible changes.

    Stray entries (a code without its sentinel) change nothing; see indexlog.strict_violations().
    """
    changes = committed_changes(log, sealed, first_seq, block_bits).where("op != 'stray'")
    last = changes.groupBy("disk_id", "fid").agg(F.max(F.struct("pos", "op", "seq", "size", "actual_fid", "actual_size", "jump_code", "jump", "packed")).alias("r"))
    return last.where("r.op = 'put'").select("disk_id", "fid", "r.size", "r.actual_fid", "r.actual_size", "r.jump_code", "r.seq", "r.jump", "r.packed")


def watermarks(log: DataFrame, first_seq: int = 1, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Per disk: entries, last_seq, the contiguous committed watermark, held rows and end_seq.

    The watermark is the last seq with no gap before it (first_seq - 1 if the log does
    not begin at first_seq); held counts the rows behind it; end_seq is the seq of the
    first terminator, null while none came.
    """
    e = _edges(_blocks(ordered_entries(log), block_bits))
    disk = e.groupBy("disk_id").agg(
        F.sum("n").alias("entries"), F.max("last_row.seq").alias("last_seq"), F.min("log_start").alias("log_start"), F.min("gap_seq").alias("gap_seq"), F.min("gap_prev").alias("gap_prev"), F.min("end_seq").alias("end_seq")
    )
    mark = F.when(F.col("log_start") != first_seq, F.lit(first_seq - 1)).when(F.col("gap_seq").isNotNull(), F.col("gap_prev")).otherwise(F.col("last_seq"))
    disk = disk.withColumn("watermark", mark.cast("long"))
    return disk.select("disk_id", "entries", "last_seq", "watermark", (F.col("entries") - F.greatest(F.col("watermark") - first_seq + 1, F.lit(0))).alias("held"), "end_seq")


def arrived_by(log: DataFrame, share: float) -> DataFrame:
    """The rows of a log that had come when `share` of the time over which it came had passed; rows without a time have not."""
    t = F.unix_micros("arrived_at")
    lo, hi = log.agg(F.min(t), F.max(t)).first()
    return log.limit(0) if lo is None else log.where(t <= lo + int((hi - lo) * share))

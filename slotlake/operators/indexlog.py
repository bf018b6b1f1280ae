"""Index logs: strict replay, compaction, validation, lookups and scrubbing of packed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..types import ANCHOR_CODE, ENTRY_BYTES, INDEX_BYTES, JUMP_SENTINEL, PACKED_SENTINEL
from ..session import broadcast_if_small, cut
from .changefeed import BLOCK_BITS, _blocks, _edges, committed_changes, entry_kind, latest_records, ordered_entries
from .consolidate import valid_entries
from .prefix import blocked_running_sum


def with_kind(log: DataFrame) -> DataFrame:
    """The ordered entries of a log with their kind, each seq once, up to its terminator. The end of a log comes with the summaries of its blocks."""
    rows = _blocks(ordered_entries(log), BLOCK_BITS)
    live = rows.join(_edges(rows).select("disk_id", "block", "end_seq"), ["disk_id", "block"]).where("end_seq is null or seq < end_seq")
    return live.select("disk_id", "seq", "fid", "size", "code", entry_kind(F.col("size"), F.col("code")).alias("kind"))


def index_end(log: DataFrame) -> DataFrame:
    """(disk_id, end_seq): the first terminator of each disk, null where the log is full to its end."""
    e = ordered_entries(log)
    zero = (F.col("fid") == 0) & (F.col("size") == 0) & (F.col("code") == 0)
    return e.groupBy("disk_id").agg(F.min(F.when(zero, F.col("seq"))).alias("end_seq"))


def find_latest(log: DataFrame, wanted: DataFrame, lenient: bool = False) -> DataFrame:
    """Point lookups: the record of every wanted (disk_id, fid): status found, not_found or invalid_pair, size, target_fid, seq.

    A lookup reads the log as it lies: a pair gives its fid the size less one, and the row
    that completes it is an entry of its own fid, too; of an anchor pair the real entry
    wins. A jump indicator with no plain entry behind it spoils the log of its disk
    (invalid_pair). lenient reads it as latest_records() does, which skips such pairs and
    knows no record of a jump's target. Wanted rows are narrow and meet the records in an
    equi-join; a disk's faults are a catalog.
    """
    x = wanted.select("disk_id", "fid").distinct()
    if lenient:
        r = latest_records(log)
        x = x.join(r, ["disk_id", "fid"], "left")
        return x.select("disk_id", "fid", F.when(F.col("seq").isNull(), "not_found").otherwise("found").alias("status"), "size", F.col("actual_fid").alias("target_fid"), "seq")
    rows = _blocks(ordered_entries(log), BLOCK_BITS)
    e = rows.join(_edges(rows).select("disk_id", "block", "row_before", "end_seq"), ["disk_id", "block"]).where("end_seq is null or seq < end_seq")
    e = e.withColumn("head", F.when(F.col("rn") == 1, F.col("row_before")).otherwise(F.col("prev")))
    pending = F.coalesce((F.col("head.code") != 0) & (F.col("head.size") == JUMP_SENTINEL), F.lit(False))
    spoilt = e.where(pending & ((F.col("code") != 0) | (F.col("size") == 0))).select("disk_id").distinct().withColumn("spoilt", F.lit(True))
    event = lambda own, fid, seq, size, target: F.struct(F.col("seq").alias("pos"), F.lit(own).alias("own"), fid.alias("fid"), seq.alias("seq"), size.alias("size"), target.alias("target_fid"))
    pair = F.when(pending, event(0, F.col("head.fid"), F.col("head.seq"), F.col("size") - 1, F.col("fid")))
    own = F.when(~((F.col("code") != 0) & (F.col("size") == JUMP_SENTINEL)), event(1, F.col("fid"), F.col("seq"), F.col("size"), F.col("fid")))
    events = e.select("disk_id", F.explode(F.array_compact(F.array(pair, own))).alias("v")).select("disk_id", F.col("v.fid").alias("fid"), "v")
    last = events.groupBy("disk_id", "fid").agg(F.max("v").alias("v"))
    x = x.join(last, ["disk_id", "fid"], "left").join(broadcast_if_small(spoilt), "disk_id", "left")
    status = F.when(F.col("spoilt"), "invalid_pair").when(F.coalesce(F.col("v.size"), F.lit(0)) == 0, "not_found").otherwise("found")
    found = status == "found"
    return x.select("disk_id", "fid", status.alias("status"), *(F.when(found, F.col(f"v.{c}")).alias(c) for c in ("size", "target_fid", "seq")))


def replay_refs(log: DataFrame, packed: DataFrame | None = None) -> DataFrame:
    """refs (disk_id, fid, target_fid, stored_size, size, byte_offset, packed) after strict replay.

    A jump pair gives the alias (one byte shorter) and its target; an anchor pair the
    packed table; the valid entries of live packed tables override what the log says.
    """
    changes = committed_changes(log).where("op != 'stray'")
    alias_target = changes.where("op = 'put' and jump").select("disk_id", "pos", "op", F.col("actual_fid").alias("fid"), "seq", F.col("actual_size").alias("size"), "actual_fid", "actual_size", "jump_code", F.lit(False).alias("jump"), "packed")
    every = changes.unionByName(alias_target)
    last = every.groupBy("disk_id", "fid").agg(F.max(F.struct("pos", "op", "size", "actual_fid", "actual_size", "jump", "packed")).alias("r")).where("r.op = 'put'")
    direct = last.select("disk_id", "fid", F.col("r.actual_fid").alias("target_fid"), F.col("r.actual_size").alias("stored_size"), F.col("r.size").alias("size"), F.lit(0).cast("long").alias("byte_offset"), F.lit(False).alias("packed"))
    if packed is None:
        return direct
    tables = last.where("r.packed").select("disk_id", F.col("fid").alias("table_fid"))
    inside = valid_entries(packed).join(tables, ["disk_id", "table_fid"], "left_semi")
    inside = inside.groupBy("disk_id", "fid").agg(F.max(F.struct("container_fid", "byte_offset", "size")).alias("e"))
    sizes = packed.groupBy("disk_id", "container_fid").agg(F.max("container_size").alias("stored_size"))
    inside = inside.select("disk_id", "fid", F.col("e.container_fid").alias("container_fid"), F.col("e.size").alias("size"), F.col("e.byte_offset").alias("byte_offset")).join(sizes, ["disk_id", "container_fid"])
    inside = inside.select("disk_id", "fid", F.col("container_fid").alias("target_fid"), "stored_size", "size", "byte_offset", F.lit(True).alias("packed"))
    return direct.join(inside.select("disk_id", "fid"), ["disk_id", "fid"], "left_anti").unionByName(inside)


def _broken(entries: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, disk_id, seq, fid) of the entries for which a rule's condition holds, all rules in one pass."""
    names = F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules.items())))
    return entries.select(F.explode(names).alias("rule"), "disk_id", "seq", "fid")


def strict_violations(log: DataFrame) -> DataFrame:
    """(rule, disk_id, seq, fid) of all that a strict replay refuses.

    duplicate_fid: a plain entry for a fid that is live; indicator_twice: an indicator
    while a pair is open; stray_code: a code without its sentinel outside a pair;
    dangling: the log ends in an open pair. In strict reading a tombstone does not close
    a pair, so whether one is open is told by the last entry that is not a tombstone.
    """
    e = with_kind(log).withColumn("block", F.coalesce(F.shiftright("seq", 16), F.lit(0).cast("long"))).repartition("disk_id", "block")
    d = W.partitionBy("disk_id", "block").orderBy("seq")
    e = e.withColumn("ind", F.col("kind").isin("jump", "anchor")).withColumn("solid", F.when(F.col("kind") != "tombstone", F.struct("seq", "ind")))
    e = e.withColumn("inner", F.last("solid", ignorenulls=True).over(d.rowsBetween(W.unboundedPreceding, -1)))
    edge = e.groupBy("disk_id", "block").agg(F.max("solid").alias("last_solid"))
    g = W.partitionBy("disk_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    edge = edge.select("disk_id", "block", F.last("last_solid", ignorenulls=True).over(g).alias("outer"))
    x = e.join(edge, ["disk_id", "block"]).withColumn("before", F.coalesce("inner", "outer"))
    pending = F.coalesce(F.col("before.ind"), F.lit(False))
    pairs = _broken(x, {"indicator_twice": pending & F.col("ind"), "stray_code": (F.col("kind") == "stray") & ~pending})
    tail = x.where("kind != 'tombstone'").groupBy("disk_id").agg(F.max(F.struct("seq", "ind", "fid")).alias("t"))
    dangling = tail.where("t.ind").select(F.lit("dangling").alias("rule"), "disk_id", F.col("t.seq").alias("seq"), F.col("t.fid").alias("fid"))
    # A fid's own changes in order: per block of the log, then from block to block, so that
    # a fid with a third of all changes is many tasks.
    life = committed_changes(log).where("op != 'stray'").select("disk_id", "fid", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", "op", "jump", "packed")
    k = W.partitionBy("disk_id", "fid", "block").orderBy("pos")
    first = F.row_number().over(k) == 1
    inner = life.withColumn("was", F.lag("op").over(k)).withColumn("first", first)
    ends = life.groupBy("disk_id", "fid", "block").agg(F.max(F.struct("pos", "op")).alias("last"))
    ends = ends.select("disk_id", "fid", "block", F.lag("last.op").over(W.partitionBy("disk_id", "fid").orderBy("block")).alias("before"))
    edge = inner.where("first").drop("was").join(ends, ["disk_id", "fid", "block"]).withColumnRenamed("before", "was")
    again = inner.where("not first").select("disk_id", "fid", "pos", "op", "was", "jump", "packed").unionByName(edge.select("disk_id", "fid", "pos", "op", "was", "jump", "packed"))
    again = again.where("op = 'put' and was = 'put' and not packed and not jump")
    duplicate = again.select(F.lit("duplicate_fid").alias("rule"), "disk_id", F.col("pos").alias("seq"), "fid")
    return duplicate.unionByName(pairs).unionByName(dangling)


def replay_refusals(log: DataFrame, packed: DataFrame, slots: Column) -> DataFrame:
    """(rule, disk_id, fid) of what a strict replay refuses beyond strict_violations(): overlap, packed_table.

    overlap: an object whose extent begins inside that of an earlier one; slots: an
    expression over disk_id. packed_table: a live packed table that cannot be read: none of
    that name, no container, or an entry that is not valid.
    """
    from . import placement

    refs = replay_refs(log)
    own = refs.where("target_fid = fid").select("disk_id", "fid", F.col("stored_size").alias("size"))
    over = placement.occupancy_violations(placement.extents(own, slots).where("start is not null")).select(F.lit("overlap").alias("rule"), "disk_id", "fid")
    bad_entry = F.exists(F.coalesce("entries", F.array().cast("array<struct<fid:bigint,byte_offset:bigint,size:bigint>>")), lambda e: F.coalesce((e["size"] <= 0) | (e["byte_offset"] + e["size"] > F.col("container_size")), F.lit(True)))
    sound = packed.groupBy("disk_id", F.col("table_fid").alias("fid")).agg(F.bool_and(~bad_entry & (F.coalesce("container_size", F.lit(0)) > 0)).alias("sound"))
    tables = latest_records(log).where("packed").select("disk_id", "fid").join(sound, ["disk_id", "fid"], "left").where("not coalesce(sound, false)")
    return over.unionByName(tables.select(F.lit("packed_table").alias("rule"), "disk_id", "fid"))


def compacted(log: DataFrame) -> DataFrame:
    """compact_entries(), written once and validated; ValueError with the first faults if it must not replace the log."""
    e = cut(compact_entries(log))
    bad = validate_compacted(e).limit(5).collect()
    if bad:
        raise ValueError(f"compacted log: {[tuple(r) for r in bad]}")
    return e


def compact_entries(log: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The compacted log (disk_id, seq, fid, size, jump_code): one entry per plain record, two per pair, in seq order.

    Entries are numbered from 1 per disk by sums per block of seq, never by one task per disk.
    """
    r = latest_records(log)
    pair = F.col("jump") | F.col("packed")
    sentinel = F.when(F.col("packed"), F.lit(PACKED_SENTINEL)).otherwise(F.lit(JUMP_SENTINEL))
    head = F.struct(F.lit(0).alias("sub"), F.col("fid").alias("fid"), F.when(pair, sentinel).otherwise(F.col("actual_size")).alias("size"), F.when(pair, F.col("jump_code")).otherwise(0).alias("jump_code"))
    body = F.struct(F.lit(1).alias("sub"), F.col("actual_fid").alias("fid"), F.col("actual_size").alias("size"), F.lit(0).alias("jump_code"))
    e = r.select("disk_id", F.col("seq").alias("at"), F.explode(F.when(pair, F.array(head, body)).otherwise(F.array(head))).alias("e")).withColumn("one", F.lit(1))
    n = blocked_running_sum(e, ["disk_id"], F.shiftright("at", block_bits), [F.col("at"), F.col("e.sub")], "one", "before")
    return n.select("disk_id", (F.col("before") + 1).alias("seq"), "e.fid", "e.size", "e.jump_code")


def validate_compacted(log: DataFrame) -> DataFrame:
    """(rule, disk_id, seq, fid) of what a compacted log must not have; empty if it is well-formed.

    Rules: tombstone, stray_code, broken_pair (an indicator without a plain entry behind
    it), duplicate_fid (a pair counts under its indicator), too_large.
    """
    e = with_kind(log).withColumn("block", F.coalesce(F.shiftright("seq", 16), F.lit(0).cast("long"))).repartition("disk_id", "block")
    d = W.partitionBy("disk_id", "block").orderBy("seq")
    e = e.withColumn("ind", F.col("kind").isin("jump", "anchor"))
    # Neighbours across a block's edge come from the first and last row of each block.
    b = e.groupBy("disk_id", "block").agg(F.min(F.struct("seq", "kind")).alias("head"), F.max(F.struct("seq", "ind")).alias("tail"))
    g = W.partitionBy("disk_id").orderBy("block")
    b = b.select("disk_id", "block", F.lead("head.kind").over(g).alias("next_kind"), F.lag("tail.ind").over(g).alias("last_ind"))
    x = e.withColumn("inner_next", F.lead("kind").over(d)).withColumn("inner_ind", F.lag("ind").over(d)).join(b, ["disk_id", "block"])
    following, opened = F.coalesce("inner_next", "next_kind"), F.coalesce(F.coalesce("inner_ind", "last_ind"), F.lit(False))
    out = _broken(x, {"tombstone": F.col("kind") == "tombstone", "stray_code": F.col("kind") == "stray", "broken_pair": F.col("ind") & (F.coalesce(following, F.lit("")) != "plain")})
    keys = x.where(F.col("ind") | ((F.col("kind") == "plain") & ~opened)).groupBy("disk_id", "fid").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
    out = out.unionByName(keys.where("n > 1").select(F.lit("duplicate_fid").alias("rule"), "disk_id", "seq", "fid"))
    size = e.groupBy("disk_id").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"))
    return out.unionByName(size.where(F.col("n") * ENTRY_BYTES > INDEX_BYTES).select(F.lit("too_large").alias("rule"), "disk_id", "seq", F.lit(0).cast("long").alias("fid")))


def cross_disk_duplicates(records: DataFrame) -> DataFrame:
    """(fid, disks) of the fids on more than one disk, at which a pool refuses to start."""
    return records.groupBy("fid").agg(F.count_distinct("disk_id").alias("disks")).where("disks > 1")


def scrub(packed: DataFrame, refs: DataFrame) -> DataFrame:
    """(disk_id, table_fid, stored, entries, bad_entries, reason) of every packed table; reason null if sound.

    The first fault counts: no_ref (the table is not stored), container_size, length (its
    stored size is not 48 + 24 n), entry_size, entry_range.
    """
    one = packed.groupBy("disk_id", "table_fid").agg(F.max_by(F.struct("container_size", "entries"), F.struct("container_size", "container_fid", F.size("entries"))).alias("t"))
    stored = refs.groupBy("disk_id", "fid").agg(F.max(F.coalesce("stored_size", "size")).alias("stored")).withColumnRenamed("fid", "table_fid")
    bad_size = F.exists("t.entries", lambda e: F.coalesce(e["size"], F.lit(0)) <= 0)
    out_of_range = lambda e: F.coalesce(e["byte_offset"] + e["size"] > F.col("t.container_size"), F.lit(True))
    n = F.size(F.coalesce("t.entries", F.array().cast("array<struct<fid:bigint,byte_offset:bigint,size:bigint>>")))
    reason = (
        F.when(F.col("stored").isNull(), "no_ref")
        .when(F.coalesce("t.container_size", F.lit(0)) <= 0, "container_size")
        .when(F.col("stored") != 48 + 24 * n, "length")
        .when(bad_size, "entry_size")
        .when(F.exists("t.entries", out_of_range), "entry_range")
    )
    bad = F.size(F.filter("t.entries", lambda e: (F.coalesce(e["size"], F.lit(0)) <= 0) | out_of_range(e)))
    return one.join(stored, ["disk_id", "table_fid"], "left").select("disk_id", "table_fid", "stored", n.cast("long").alias("entries"), bad.cast("long").alias("bad_entries"), reason.alias("reason"))


def without_tables(log: DataFrame, tables: DataFrame) -> DataFrame:
    """The log with a tombstone behind its end for every packed table of tables (disk_id, table_fid): what a scrub drops."""
    e = with_kind(log).select("disk_id", "seq", "fid", "size", F.col("code").alias("jump_code"))
    ends = e.groupBy("disk_id").agg(F.max("seq").alias("last"))
    n = F.row_number().over(W.partitionBy("disk_id").orderBy("table_fid"))
    dead = tables.distinct().join(ends, "disk_id").select("disk_id", (F.col("last") + n).alias("seq"), F.col("table_fid").alias("fid"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("jump_code"))
    return e.unionByName(dead)


def scrub_fix(records: DataFrame, report: DataFrame) -> DataFrame:
    """The records without the packed tables that a scrub found bad."""
    bad = report.where("reason is not null").select("disk_id", F.col("table_fid").alias("fid"))
    return records.where("packed").join(bad, ["disk_id", "fid"], "left_anti").unionByName(records.where("not packed"))


def backup(log: DataFrame, path: str) -> None:
    """The whole log, one folder per disk, in seq order inside each file."""
    log.repartitionByRange("disk_id", "seq").sortWithinPartitions("disk_id", "seq").write.mode("errorifexists").partitionBy("disk_id").option("compression", "zstd").parquet(path)


def restore(spark, path: str, disk_id: int, expected: int | None = None, force: bool = False) -> DataFrame:
    """One disk's log from a backup; a backup of another disk only with force, and a backup without the disk not at all."""
    if expected is not None and expected != disk_id and not force:
        raise ValueError("the backup belongs to another disk")
    log = spark.read.parquet(path).where(F.col("disk_id") == disk_id)
    if log.isEmpty():
        raise ValueError("the backup has no such disk")
    return log.withColumn("disk_id", F.col("disk_id").cast("long"))


def anchor_rows(records: DataFrame) -> DataFrame:
    """The two log rows that publish a packed table: its anchor and its real entry."""
    head = F.struct(F.lit(0).alias("sub"), F.col("fid"), F.lit(PACKED_SENTINEL).alias("size"), F.lit(ANCHOR_CODE).alias("jump_code"))
    body = F.struct(F.lit(1).alias("sub"), F.col("fid"), F.col("size"), F.lit(0).alias("jump_code"))
    return records.select("disk_id", F.inline(F.array(head, body)))

"""Extents, overlap, free room and the choice of a disk."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.address import address, floor_log2, overlaps, slot_count
from ..functions.fid import sample_fids, xxh3_jumps
from ..session import broadcast_if_small, cut
from ..types import CHD_SAMPLES, CHD_TARGET_P, ENTRY_BYTES, INDEX_BYTES, MAX_PUT, SLOT_BYTES

#: Slots per bucket of the interval join.
BUCKET = 64


def extents(objects: DataFrame, slots: Column) -> DataFrame:
    """objects plus start, end (inclusive slots) and reason; start and end are null where reason is not."""
    a = objects.withColumn("_a", address(slots, F.col("fid"), F.col("size")))
    return a.select(*objects.columns, F.col("_a.slot").alias("start"), (F.col("_a.slot") + F.col("_a.need") - 1).alias("end"), F.col("_a.reason").alias("reason"))


def overlap_pairs(left: DataFrame, right: DataFrame, group: list[str], bucket: int = BUCKET) -> DataFrame:
    """Rows of left (l) and right (r) of one group whose inclusive intervals share a slot.

    An equi-join on (group, bucket of slots) instead of a theta join: each interval is
    written once per bucket it touches, and a pair counts only in the first bucket they
    share. Columns are structs l and r. Null bounds match nothing.
    """
    spread = lambda df, name: df.where("start is not null and end is not null").select(
        *(F.col(g).alias(f"_{g}") for g in group), F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("_bucket"), F.struct(*df.columns).alias(name)
    )
    j = spread(left, "l").join(spread(right, "r"), [*(f"_{g}" for g in group), "_bucket"])
    return j.where(overlaps(F.col("l.start"), F.col("l.end"), F.col("r.start"), F.col("r.end")) & (F.col("_bucket") == F.floor(F.greatest("l.start", "r.start") / bucket))).select("l", "r")


def conflicts(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """(group, a, b) of every pair of rows, a < b by key, whose extents overlap.

    Pairs are those of the collision graph, which slots bound; nothing is enumerated
    that does not collide.
    """
    p = overlap_pairs(rows, rows, group).where(F.col(f"l.{key}") < F.col(f"r.{key}"))
    return p.select(*(F.col(f"l.{g}").alias(g) for g in group), F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b"))


def free_of(rows: DataFrame, taken: DataFrame, group: list[str]) -> DataFrame:
    """The rows that overlap no taken extent (reserve: the others are conflicts)."""
    hit = overlap_pairs(rows, taken.select(*group, "start", "end"), group).select("l.*")
    return rows.join(hit.select(*group, "fid").distinct(), [*group, "fid"], "left_anti")


def any_overlap(rows: DataFrame, taken: DataFrame, group: list[str]) -> DataFrame:
    """The rows that overlap a taken extent of their group, each once."""
    hit = overlap_pairs(rows, taken.select(*group, "start", "end"), group).select("l.*")
    return rows.join(hit.select(*group, "fid").distinct(), [*group, "fid"], "left_semi")


def _block(at: str, width: int) -> Column:
    """The block of a position; never null, so that a join on it adds no filter and both its sides share a shuffle."""
    return F.coalesce(F.floor(F.col(at) / width), F.lit(0).cast("long"))


def occupancy_violations(rows: DataFrame, block_slots: int = 1 << 20) -> DataFrame:
    """(disk_id, fid, start, previous_end): extents that begin at or before the end of an earlier one.

    Compares each with the furthest end before it, per disk in blocks of slots, so one
    large disk is spread over many tasks. Exact duplicates count too.
    """
    b = rows.where("start is not null").withColumn("block", _block("start", block_slots)).repartition("disk_id", "block")
    w = W.partitionBy("disk_id", "block").orderBy("start", "end", "fid").rowsBetween(W.unboundedPreceding, -1)
    g = W.partitionBy("disk_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    tops = b.groupBy("disk_id", "block").agg(F.max("end").alias("top"))
    tops = tops.select("disk_id", "block", F.max("top").over(g).alias("outer"))
    x = b.withColumn("inner", F.max("end").over(w)).join(tops, ["disk_id", "block"])
    return x.select("disk_id", "fid", "start", F.greatest("inner", "outer").alias("previous_end")).where("start <= previous_end")


def required_samples(p: float | None) -> int:
    """Samples of 64 that must be free; p outside (0, 1] or not a number counts as 0.2."""
    if p is None or math.isnan(p) or not 0 < p <= 1:
        p = CHD_TARGET_P
    return math.ceil(p * CHD_SAMPLES)


def chd_bytes(disk_id: int, slots: int, starts: Iterable[int], ends: Iterable[int], p: float | None = CHD_TARGET_P) -> int:
    """Room estimate of one disk: the size the binary search over 1..slots settles on, in bytes.

    A size counts as free when enough of the disk's 64 sample fids would land on slots that
    no extent (inclusive, in any order) touches. The search path decides: success is not
    monotone in the size.
    """
    need = required_samples(p)
    s = np.sort(np.asarray(list(starts), dtype=np.int64))
    e = np.sort(np.asarray(list(ends), dtype=np.int64))
    fids = np.array(sample_fids(disk_id), dtype=np.int64).view(np.uint64)

    def free(size: int) -> bool:
        at = (fids % np.uint64(slots - size + 1)).astype(np.int64)
        # Extents that begin by the last slot and those that end before the first differ by the overlapping ones.
        hit = np.searchsorted(s, at + size - 1, side="right") - np.searchsorted(e, at, side="left")
        return int((hit == 0).sum()) >= need

    low, high, best = 1, slots, 0
    while low <= high:
        middle = (low + high) // 2
        if free(middle):
            best, low = middle, middle + 1
        else:
            high = middle - 1
    return best * SLOT_BYTES


def chd(disks: DataFrame, taken: DataFrame, p: float | None = CHD_TARGET_P) -> DataFrame:
    """(disk_id, chd) of disks (disk_id, slots) over their extents (disk_id, start, end).

    Extents of a disk are merged to runs of taken slots first (their number is bounded
    by the slots of the disk), so a task holds two arrays of at most that many numbers.
    """

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[pdf["start"].notna()]
        return pd.DataFrame({"disk_id": pdf["disk_id"].iloc[:1], "chd": [chd_bytes(int(pdf["disk_id"].iloc[0]), int(pdf["slots"].iloc[0]), x["start"], x["end"], p)]})

    one = occupied_runs(taken)
    return disks.select("disk_id", "slots").join(one, "disk_id", "left").groupBy("disk_id").applyInPandas(estimate, "disk_id long, chd long")


def disk_slots(devices: DataFrame) -> DataFrame:
    return devices.withColumn("slots", slot_count(F.col("size_bytes")))


def can_write(size: Column, slots: Column, faulted: Column) -> Column:
    """Whether a disk could hold an object of this size at all: not faulted, and the whole grid is large enough. A full disk is."""
    return (size > 0) & (size <= slots * SLOT_BYTES) & ~faulted


def _step(size: Column) -> Column:
    """A rising step function of sizes above 0: 16 steps for each power of two."""
    power = floor_log2(size)
    return (power * 16 + F.floor(size / F.pow(F.lit(2.0), power) * 16) - 16).cast("int")


def choices(disks: DataFrame, small_bytes: int) -> DataFrame:
    """(tier, below, upto, disk_id): the disk that a size in (below, upto] goes to, for the zram and for the disk tier.

    disks: disk_id, pool_pos, is_zram, faulted, slots, chd. Per tier at most two rows for each disk.
    """
    d = disks.where(~F.col("faulted") & (F.col("slots") > 0)).select("disk_id", "pool_pos", F.when(F.col("is_zram"), "zram").otherwise("disk").alias("tier"), (F.col("slots") * SLOT_BYTES).alias("most"), "chd")
    d = d.withColumn("room", F.least("chd", "most"))
    first = F.min_by("disk_id", F.struct("pool_pos", "disk_id"))
    t = W.partitionBy("tier")
    fit = d.where("room > 0").groupBy("tier", "room").agg(first.alias("disk_id")).select("tier", F.lag("room", 1, 0).over(t.orderBy("room")).alias("below"), F.col("room").alias("upto"), "disk_id")
    # An ordinary disk that can hold the object, though its estimate is too small: the one with the most room.
    rest = d.where("tier = 'disk'").withColumn("top", F.max("room").over(t))
    steps = rest.groupBy("tier", "most", "top").agg(F.max(F.struct("chd", (-F.col("pool_pos")).alias("p"), (-F.col("disk_id").cast("decimal(20,0)")).alias("i"))).alias("b"))
    w = t.orderBy(F.col("most").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = steps.select("tier", F.greatest("top", F.lag("most", 1, 0).over(t.orderBy("most"))).alias("below"), F.col("most").alias("upto"), (-F.max("b").over(w)["i"]).cast("long").alias("disk_id"))
    every = fit.unionByName(rest).where("upto > below")
    small = F.least("upto", F.lit(min(small_bytes - 1, 2**63 - 1)))
    return every.select("tier", "below", F.when(F.col("tier") == "zram", small).otherwise(F.col("upto")).alias("upto"), "disk_id").where("upto > below")


def route(requests: DataFrame, disks: DataFrame, small_bytes: int) -> DataFrame:
    """(req_id, size, disk_id, tier): the disk each size goes to, null where none can take it.

    disks: disk_id, pool_pos, is_zram, faulted, slots, chd. A small object takes the zram
    disk with the least sufficient room, else, as any other, the ordinary disk with the
    least sufficient room; if no ordinary disk has enough by its estimate, the one with
    the most of those whose grid can hold it. Ties go to the first in the pool. The
    catalog becomes a table of size ranges, which requests meet in the steps of their
    size: an equi-join, broadcast if the table is small.
    """
    c = broadcast_if_small(choices(disks, small_bytes).select("*", F.explode(F.sequence(_step(F.col("below") + 1), _step(F.col("upto")))).alias("step")))
    at = lambda tier: c.where(F.col("tier") == tier).select("step", "below", "upto", F.col("disk_id").alias(tier))
    x = requests.select("req_id", "size", F.when(F.col("size") > 0, _step(F.col("size"))).alias("step"))
    for tier in ("zram", "disk"):
        r = at(tier)
        x = x.join(r, (x["step"] == r["step"]) & (x["size"] > r["below"]) & (x["size"] <= r["upto"]), "left").select(x["*"], r[tier])
    return x.select("req_id", "size", F.coalesce("zram", "disk").alias("disk_id"), F.when(F.col("zram").isNotNull(), "zram").when(F.col("disk").isNotNull(), "disk").alias("tier"))


def bonnie(disks: DataFrame, max_put: int = MAX_PUT) -> DataFrame:
    """(ch_d_pow2, bytes): the largest room of a writable ordinary disk as a power of two, capped at max_put if that is above 0; 0 where none."""
    room = F.least("chd", F.lit(max_put)) if max_put > 0 else F.col("chd")
    top = F.max(F.when(~F.col("is_zram") & can_write(F.lit(1), F.col("slots"), F.col("faulted")), room))
    p = disks.agg(F.coalesce(top, F.lit(0)).alias("room")).select(floor_log2(F.col("room")).alias("ch_d_pow2"))
    return p.select("ch_d_pow2", F.pow(F.lit(2.0), F.col("ch_d_pow2")).cast("long").alias("bytes"))


def health(disks: DataFrame, degraded: bool = False) -> DataFrame:
    """(ok): at least one disk, none faulted, each able to hold one byte (full ones are), pool not degraded."""
    fine = F.bool_and(can_write(F.lit(1), F.col("slots"), F.col("faulted")))
    return disks.agg((F.coalesce(fine, F.lit(False)) & F.lit(not degraded)).alias("ok"))


def index_capacity(devices: DataFrame, entry_overhead: int = 64) -> DataFrame:
    """(disks, max_entries, max_ram_bytes) a pool's index can reach."""
    per_disk = INDEX_BYTES // ENTRY_BYTES
    n = F.count(F.lit(1))
    return devices.agg(n.alias("disks"), (n * per_disk).alias("max_entries"), (n * per_disk * entry_overhead).alias("max_ram_bytes"))


def logical_sizes(refs: DataFrame) -> DataFrame:
    """(disk_id, fid, size) of direct objects: no aliases, no alias targets, nothing packed."""
    aliases = refs.where("target_fid != fid and not coalesce(packed, false)").select("disk_id", F.col("target_fid").alias("fid")).distinct()
    own = refs.where("(target_fid is null or target_fid = fid) and not coalesce(packed, false)")
    return own.groupBy("disk_id", "fid").agg(F.max(F.coalesce("size", "stored_size")).alias("size")).join(aliases, ["disk_id", "fid"], "left_anti")


_PLACED = "disk_id long, seq long, fid long, target_fid long, jumps_taken int, status string, slot long"
#: Jump fids worked out for a request that needs them: first so many, then all.
JUMPS_FIRST = 16


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Puts of rows in order of (disk_id, seq), one by one; a disk's state is its slots (one byte each) and its fids."""
    disk, free, fids = None, np.zeros(0, dtype=bool), set()
    for b in batches:
        out = []
        for d, seq, fid, size, slots, reason, jumps, all_jumps in zip(b["disk_id"], b["seq"], b["fid"], b["size"], b["slots"], b["reason"], b["jumps"], b["all_jumps"], strict=True):
            if d != disk:
                disk, free, fids = d, np.ones(int(slots), dtype=bool), set()
            if reason is not None:
                # A taken extent is a row of its own and comes first.
                if reason == "taken":
                    free[int(fid) : int(fid) + int(size)] = False
                else:
                    out.append((d, seq, fid, fid, 0, reason, None))
                continue
            if fid in fids:
                out.append((d, seq, fid, fid, 0, "duplicate", None))
                continue
            done = None
            for j, f in enumerate([fid, *(jumps if jumps is not None else ())]):
                need = -(-(int(size) + (j > 0)) // SLOT_BYTES)
                if need > slots:
                    break
                if j and f in fids:
                    continue
                start = (int(f) & (2**64 - 1)) % (int(slots) - need + 1)
                if free[start : start + need].all():
                    free[start : start + need] = False
                    fids.update((fid, f))
                    done = (d, seq, fid, f, j, "ok", start)
                    break
            tried = 0 if jumps is None else len(jumps)
            out.append(done or (d, seq, fid, fid, tried, "more" if tried < all_jumps else "jump_exhausted" if all_jumps else "extent", None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PLACED.split(", ")]).astype({"slot": "Int64"})


def put_in_order(requests: DataFrame, taken: DataFrame | None = None, max_jumps: int = 0, jump_fids: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """(disk_id, seq, fid, target_fid, jumps_taken, status, slot) of puts as if placed one by one in seq order, per disk.

    requests: disk_id, slots (of the disk), seq (unique), fid, size, payload (read only where a
    jump is tried). taken: disk_id, start, end of extents that are there before. A put
    lands on the slots of its fid; an extent in the way makes it jump: the payload with one
    byte behind it under jump fids 1, 2, ... up to max_jumps, with the fid as an alias.
    status: ok, duplicate (its fid, or as a fid the target of an earlier jump, is there),
    extent (without jumps), jump_exhausted, or the reason of address().

    Of requests with the same fid and size only the first is placed; the others are
    duplicates if one of the fid was placed before them, else they fail as it did. A disk
    is placed by one task, as each put depends on those before; the rows that pass
    through it are narrow and stream, and what it keeps is bounded by the disk's slots.
    Jump fids are worked out only for requests that turn out to need them: the order is
    replayed until none asks for more.
    """
    of = jump_fids or (lambda payload, n: xxh3_jumps(payload, F.lit(n)))
    q = requests.where("seq is not null and disk_id is not null and fid is not null").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    base = cut(q.groupBy("disk_id", "fid", "size").agg(F.min("seq").alias("seq"), F.max("slots").cast("long").alias("slots")).withColumn("reason", address(F.col("slots"), F.col("fid"), F.col("size"))["reason"]))
    slots = base.groupBy("disk_id").agg(F.max("slots").alias("slots"))
    first = F.lit(-(2**63)).cast("long")
    before = slots.limit(0).select("disk_id", F.lit(0).cast("long").alias("fid"), F.lit(0).cast("long").alias("size"), first.alias("seq"), "slots", F.lit("taken").alias("reason"))
    if taken is not None:
        before = taken.where("start is not null and end is not null").join(slots, "disk_id").select("disk_id", F.col("start").alias("fid"), (F.col("end") - F.col("start") + 1).alias("size"), first.alias("seq"), "slots", F.lit("taken").alias("reason"))
    before = before.withColumn("jumps", F.lit(None).cast("array<long>")).withColumn("all_jumps", F.lit(0))
    known = base.limit(0).select("disk_id", "seq", F.array().cast("array<long>").alias("jumps"))
    disks = max(1, slots.count())

    def jumps_of(asking: DataFrame, tries: int) -> DataFrame:
        return q.select("disk_id", "seq", "payload").join(asking, ["disk_id", "seq"], "left_semi").select("disk_id", "seq", of(F.col("payload"), tries).alias("jumps"))

    if max_jumps:
        # Those whose own extents meet another's will ask most likely; the replay finds the others.
        at = address(F.col("slots"), F.col("fid"), F.col("size"))
        direct = base.where("reason is null").select("disk_id", F.col("seq").alias("fid"), at["slot"].alias("start"), (at["slot"] + at["need"] - 1).alias("end"))
        there = before.select("disk_id", F.col("seq").alias("fid"), F.col("fid").alias("start"), (F.col("fid") + F.col("size") - 1).alias("end"))
        known = cut(jumps_of(contested(direct.unionByName(there)).select("disk_id", F.col("fid").alias("seq")).distinct(), min(JUMPS_FIRST, max_jumps)))
    for tries in dict.fromkeys((min(JUMPS_FIRST, max_jumps), max_jumps)):
        while True:
            rows = base.join(known, ["disk_id", "seq"], "left").withColumn("all_jumps", F.lit(max_jumps)).unionByName(before)
            placed = cut(rows.repartition(disks, "disk_id").sortWithinPartitions("disk_id", "seq").mapInPandas(_fold, _PLACED))
            asking = placed.where((F.col("status") == "more") & (F.col("jumps_taken") < tries)).select("disk_id", "seq")
            if not max_jumps or asking.isEmpty():
                break
            known = cut(known.join(asking, ["disk_id", "seq"], "left_anti").unionByName(jumps_of(asking, tries)))
    p = placed.join(base.select("disk_id", "seq", "size"), ["disk_id", "seq"])
    outcome = p.select("disk_id", "fid", "size", F.struct("seq", "target_fid", "jumps_taken", "status", "slot").alias("p"))
    stored = p.where("status = 'ok'").select("disk_id", "target_fid", "fid", "seq").select("disk_id", "seq", F.explode(F.array_distinct(F.array("fid", "target_fid"))).alias("fid")).groupBy("disk_id", "fid").agg(F.min("seq").alias("stored"))
    x = q.select("disk_id", "seq", "fid", "size").join(outcome, ["disk_id", "fid", "size"]).join(stored, ["disk_id", "fid"], "left")
    own = F.col("seq") == F.col("p.seq")
    again = F.when(own, F.col("p.status")).when(F.col("p.status").isin("empty", "too_large", "no_slots"), F.col("p.status")).when(F.col("stored") < F.col("seq"), "duplicate").otherwise(F.col("p.status"))
    x = x.withColumn("again", again)
    return x.select("disk_id", "seq", "fid", F.when(own, F.col("p.target_fid")).otherwise(F.col("fid")).alias("target_fid"), F.when(F.col("again") == "duplicate", 0).otherwise(F.col("p.jumps_taken")).alias("jumps_taken"), F.col("again").alias("status"), F.when(own, F.col("p.slot")).alias("slot"))


def place_in_order(requests: DataFrame, slots: int) -> DataFrame:
    """(seq, fid, start, end, status) of direct puts (seq, fid, size) on one disk: put_in_order() without jumps."""
    placed = put_in_order(requests.select(F.lit(0).cast("long").alias("disk_id"), F.lit(slots).cast("long").alias("slots"), "seq", "fid", "size"))
    a = requests.select("seq", address(F.lit(slots).cast("long"), F.col("fid"), F.col("size")).alias("a"))
    return placed.join(a, "seq").select("seq", "fid", F.col("a.slot").alias("start"), (F.col("a.slot") + F.col("a.need") - 1).alias("end"), "status")


def transitions(extents_: DataFrame, events: DataFrame) -> DataFrame:
    """(disk_id, fid, start, end, state) of reserved extents after events (disk_id, fid, seq, event): pending, confirmed or released.

    The last of confirm and release counts; a release after a confirm has no effect, as
    only a pending extent can be released.
    """
    e = events.where("event in ('confirm', 'release')").groupBy("disk_id", "fid").agg(F.min_by("event", "seq").alias("event"))
    state = F.when(F.col("event") == "confirm", "confirmed").when(F.col("event") == "release", "released").otherwise("pending")
    return extents_.join(e, ["disk_id", "fid"], "left").select("disk_id", "fid", "start", "end", state.alias("state"))


def current_chd(disks: DataFrame, states: DataFrame, p: float | None = CHD_TARGET_P) -> DataFrame:
    """chd() over the extents that are confirmed or pending."""
    return chd(disks, states.where("state in ('confirmed', 'pending')"), p)


def occupied_runs(taken: DataFrame, block_slots: int = 1 << 20) -> DataFrame:
    """(disk_id, start, end): a disk's taken slots as runs that neither touch nor overlap, except where a block of slots ends.

    Every extent is cut at block ends and merged per block, so a large disk is many tasks;
    a block has at most block_slots / 2 runs.
    """
    b = taken.where("start is not null and end >= start").select("disk_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block_slots), F.floor(F.col("end") / block_slots))).alias("block"))
    b = b.select("disk_id", "block", F.greatest("start", F.col("block") * block_slots).alias("start"), F.least("end", (F.col("block") + 1) * block_slots - 1).alias("end")).distinct()
    w = W.partitionBy("disk_id", "block").orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    x = b.withColumn("new", F.when(top.isNull() | (F.col("start") > top + 1), 1).otherwise(0)).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return x.groupBy("disk_id", "block", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("disk_id", "start", "end")


def contested(rows: DataFrame, block_slots: int = 1 << 20) -> DataFrame:
    """(disk_id, fid, start, end) of the extents that share a slot with another, each once.

    Found by order, not by pairs: an extent is contested if one that begins before it
    reaches into it or the next one begins inside it. Blocks of slots bound each task.
    """
    b = rows.where("start is not null").select("disk_id", "fid", "start", "end", _block("start", block_slots).alias("block")).repartition("disk_id", "block")
    o = W.partitionBy("disk_id", "block").orderBy("start", "end", "fid")
    g = W.partitionBy("disk_id").orderBy("block")
    edges = b.groupBy("disk_id", "block").agg(F.max("end").alias("top"), F.min("start").alias("low"))
    edges = edges.select("disk_id", "block", F.max("top").over(g.rowsBetween(W.unboundedPreceding, -1)).alias("outer_end"), F.lead("low").over(g).alias("outer_start"))
    x = b.withColumn("inner_end", F.max("end").over(o.rowsBetween(W.unboundedPreceding, -1))).withColumn("inner_start", F.lead("start").over(o))
    x = x.join(edges, ["disk_id", "block"])
    hit = F.coalesce(F.greatest("inner_end", "outer_end") >= F.col("start"), F.lit(False)) | F.coalesce(F.coalesce("inner_start", "outer_start") <= F.col("end"), F.lit(False))
    return x.where(hit).select("disk_id", "fid", "start", "end")

"""Far too many small objects: find them and lay them out in few well-filled containers.

The small objects of all disks are written as sorted runs (disk, unsigned fid), one for
each task that found them; the runs are merged k-way, key range by key range, and
the merge rolls containers by bytes. Containers roll over the whole disk, not per range:
each range begins where the sums of the ranges before it end, so only the last container
of a disk stays unfilled, and a disk that holds a third of all objects is many tasks.
The ranges of the containers (first and last fid) come out of the merge.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import broadcast_if_small, delete_at_end, shared_dir
from ..types import unsigned_order
from . import compaction

#: Most bytes of a container, and entries that fill it whatever their size.
CONTAINER_BYTES = 8 << 20
CONTAINER_ENTRIES = 1 << 18
#: Bytes of run rows in a key range.
RANGE_BYTES = 8 << 20
KEY = ["disk_id", "key"]


def latest_thresholds(trim_status: DataFrame) -> DataFrame:
    """(disk_id, threshold) of each disk's most recent check; a null threshold selects nothing.

    Checks without last_check_at are older than any other; on ties the larger threshold counts.
    """
    newest = F.max(F.struct("last_check_at", "last_threshold_bytes", "last_small_files"))
    return trim_status.where("disk_id is not null").groupBy("disk_id").agg(newest.alias("n")).select("disk_id", F.col("n.last_threshold_bytes").alias("threshold"), F.col("n.last_small_files").alias("reported"))


def valid_entries(packed: DataFrame) -> DataFrame:
    """(disk_id, table_fid, container_fid, fid, byte_offset, size) of the valid entries of packed tables.

    Valid: size above 0, ending within container_size. Null sizes or offsets are not valid.
    """
    e = packed.select("disk_id", "table_fid", "container_fid", "container_size", F.inline("entries").alias("fid", "byte_offset", "size"))
    return e.where("size > 0 and byte_offset + size <= container_size").drop("container_size")


def small_objects(refs: DataFrame, packed: DataFrame, trim_status: DataFrame) -> DataFrame:
    """(disk_id, fid, size, threshold) of the small objects that lie on their own, each once.

    Own: target_fid null or equal to fid, not the target of another object, neither a
    packed table nor a container, and named by no valid entry. size is stored_size where
    it is null; without either the object is not selected. All exclusions are brought to
    one (disk_id, fid) aggregate, so there is one shuffle and no join on large sides.
    """
    direct = (F.col("target_fid").isNull() | (F.col("target_fid") == F.col("fid"))).cast("int")
    own = refs.select("disk_id", "fid", F.coalesce("size", "stored_size").alias("size"), direct.alias("own"), F.lit(0).alias("out"))
    not_own = lambda df, fid: df.select("disk_id", F.col(fid).alias("fid"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("int").alias("own"), F.lit(1).alias("out"))
    pointed = refs.where("target_fid != fid")
    everything = own.unionByName(not_own(pointed, "target_fid")).unionByName(not_own(packed, "table_fid")).unionByName(not_own(packed, "container_fid")).unionByName(not_own(valid_entries(packed), "fid"))
    seen = everything.where("disk_id is not null and fid is not null").groupBy("disk_id", "fid").agg(F.min("size").alias("size"), F.min("own").alias("own"), F.max("out").alias("out"))
    alone = seen.where("out = 0 and own = 1").select("disk_id", "fid", "size")
    limits = broadcast_if_small(latest_thresholds(trim_status).select("disk_id", "threshold"))
    return alone.join(limits, "disk_id").where(F.col("size") < F.col("threshold"))


_OBJECTS = "disk_id long, fid long, size long, at long, lies long, container_no long"
_BIAS = np.int64(-(2**63))


def _charge(size: np.ndarray, threshold: np.ndarray, container_bytes: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, charge): a container's window, and what each object takes of it: its bytes and its part of the most entries."""
    window = np.maximum(container_bytes - threshold + 1, 1)
    return window, np.maximum(size + window // entries, 1)


def merged_objects(objects: DataFrame, container_bytes: int = CONTAINER_BYTES, range_bits: int = 0, entries: int = CONTAINER_ENTRIES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every object with its place: disk_id, fid, size, at, lies (what its disk holds before it, charged and in bytes), container_no.

    objects: disk_id, fid, size, threshold (an upper bound of size, one for each disk).
    They are written as sorted runs, merged k-way in unsigned fid order, and dealt to
    containers on the way: a container takes the objects that begin in its window of
    container_bytes - threshold + 1 bytes, each charged with its size and the `entries`-th
    part of the window, 1 at least. So it never exceeds container_bytes (unless the
    threshold alone does) nor twice `entries` objects, and all but the last of a disk are
    filled up to one threshold and that charge. Repeated rows of one object all stay. Null or negative sizes take no room;
    rows without disk_id or fid are left out. range_bits asks for at least
    2^range_bits key ranges.
    """
    spark = objects.sparkSession
    folder = f"{shared_dir(spark)}/small-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    rows = objects.where("disk_id is not null and fid is not null").select("disk_id", unsigned_order(F.col("fid")).alias("key"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("long").alias("size"), F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold"))
    compaction.sort_runs(rows, KEY, folder)
    found = compaction.described(spark, folder, KEY)
    total = found.agg(F.sum("bytes")).first()[0]
    if total is None:
        return spark.createDataFrame([], _OBJECTS)
    range_bytes = max(1, min(range_bytes, total >> range_bits))
    runs = compaction.few_runs(found, KEY, range_bytes).withColumn("grp", F.lit("all"))
    # A task for each range, also of a key that is repeated often: places of repeats follow each other.
    cuts = {g: (keys, {}) for g, (keys, _) in compaction.plan(runs, len(KEY), range_bytes).items()}
    sent = spark.sparkContext.broadcast(cuts.get("all", ([], {}))[0])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["size"].to_numpy()
            _, charge = _charge(size, b["threshold"].to_numpy(), container_bytes, entries)
            r = compaction.range_of(sent.value, [b["disk_id"].to_numpy(), b["key"].to_numpy()])
            yield pd.DataFrame({"range": r.astype("int32"), "disk_id": b["disk_id"], "charge": charge, "size": size}).groupby(["range", "disk_id"], as_index=False).sum()

    per_range = rows_of(runs).mapInPandas(sums, "range int, disk_id long, charge long, size long").groupBy("range", "disk_id").agg(F.sum("charge").alias("charge"), F.sum("size").alias("size"))
    # One row for each range and disk; few, as ranges follow each other disk by disk.
    w = W.partitionBy("disk_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    base = per_range.select("range", "disk_id", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("charge", "size"))).collect()
    begins = spark.sparkContext.broadcast({(r["range"], r["disk_id"]): (r["charge"], r["size"]) for r in base})

    def deal(grp: str, r: int, part: int, tables: Iterator[pa.Table]) -> Iterator[pd.DataFrame]:
        before: dict[int, tuple[int, int]] = {}
        for t in tables:
            disk, key, size, threshold = (t[c].to_numpy() for c in ("disk_id", "key", "size", "threshold"))
            window, charge = _charge(size, threshold, container_bytes, entries)
            start = np.flatnonzero(np.r_[True, disk[1:] != disk[:-1]])
            at, lies = np.cumsum(charge) - charge, np.cumsum(size) - size
            for i, j in zip(start, [*start[1:], len(disk)], strict=True):
                d = int(disk[i])
                a, n = before.get(d) or begins.value[r, d]
                at[i:j] += a - at[i]
                lies[i:j] += n - lies[i]
                before[d] = int(at[j - 1] + charge[j - 1]), int(lies[j - 1] + size[j - 1])
            yield pd.DataFrame({"disk_id": disk, "fid": key ^ _BIAS, "size": size, "at": at, "lies": lies, "container_no": at // window})

    return compaction.merged(runs, KEY, cuts, deal, _OBJECTS)


def rows_of(files: DataFrame) -> DataFrame:
    """The rows of described runs."""
    return files.sparkSession.read.parquet(*(r["path"] for r in files.select("path").collect()))


def container_ranges(placed: DataFrame) -> DataFrame:
    """(disk_id, container_no, container_size, first_fid, last_fid, objects) of merged_objects()."""
    return placed.groupBy("disk_id", "container_no").agg(
        F.sum("size").alias("container_size"), F.min_by("fid", F.struct("at", "lies")).alias("first_fid"), F.max_by("fid", F.struct("at", "lies")).alias("last_fid"), F.count(F.lit(1)).alias("objects")
    )


def entries_of(placed: DataFrame) -> DataFrame:
    """(disk_id, container_no, fid, byte_offset, size) of merged_objects(): where every object lies in its container."""
    start = F.min("lies").over(W.partitionBy("disk_id", "container_no"))
    return placed.select("disk_id", "container_no", "fid", (F.col("lies") - start).alias("byte_offset"), "size")


def consolidate(objects: DataFrame, container_bytes: int = CONTAINER_BYTES, range_bits: int = 0, entries: int = CONTAINER_ENTRIES) -> DataFrame:
    """Containers (disk_id, container_no, container_size, first_fid, last_fid, entries) of merged_objects(), each one row of at most twice `entries`."""
    at = merged_objects(objects, container_bytes, range_bits, entries)
    entry = F.struct("at", "lies", "fid", "size")
    groups = at.groupBy("disk_id", "container_no").agg(F.sort_array(F.collect_list(entry)).alias("e"), F.sum("size").alias("container_size"))
    start = F.col("e")[0]["lies"]
    return groups.select(
        "disk_id",
        "container_no",
        "container_size",
        F.col("e")[0]["fid"].alias("first_fid"),
        F.element_at("e", -1)["fid"].alias("last_fid"),
        F.transform("e", lambda x: F.struct(x["fid"].alias("fid"), (x["lies"] - start).alias("byte_offset"), x["size"].alias("size"))).alias("entries"),
    )


def container_entries(containers: DataFrame) -> DataFrame:
    """(disk_id, container_no, fid, byte_offset, size) of every object in its container."""
    return containers.select("disk_id", "container_no", F.inline("entries").alias("fid", "byte_offset", "size"))

"""Pools, devices and snapshots: discovery, selection, merging, change detection, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.codecs import HEADER_VERSION
from ..types import CAPACITY_UNIT, GRID_START, SLOT_BYTES


def select_device(pool: DataFrame, wanted: str = "") -> DataFrame:
    """The pool's first device for an empty id, else that whose 0x id matches without case."""
    if not wanted:
        return pool.orderBy("pool_pos").limit(1)
    return pool.where(F.lower(F.concat(F.lit("0x"), F.hex("disk_id"))) == wanted.lower())


def device_faults(devices: DataFrame) -> DataFrame:
    """(device_path, fault) by the first rule a device breaks: no_header, version, id, too_small, duplicate_id.

    devices: device_path, disk_id (from its header), version, size_bytes, expected_id (from the pool, may be null).
    """
    n = F.count(F.lit(1)).over(W.partitionBy("disk_id"))
    fault = (
        F.when(F.col("version").isNull(), "no_header")
        .when(F.col("version") != HEADER_VERSION, "version")
        .when(F.col("expected_id").isNotNull() & (F.col("expected_id") != F.col("disk_id")), "id")
        .when(F.col("size_bytes") <= GRID_START, "too_small")
        .when(n > 1, "duplicate_id")
    )
    return devices.select("device_path", fault.alias("fault"))


def init_fault(devices: DataFrame, force: bool = False) -> DataFrame:
    """(device_path, fault) of devices to be initialised: too_small, capacity, has_header, has_index (the last two unless forced)."""
    fault = F.when(F.col("size_bytes") < GRID_START + SLOT_BYTES, "too_small").when(F.floor(F.col("size_bytes") / CAPACITY_UNIT) > 65535, "capacity")
    if not force:
        fault = fault.when(F.col("version").isNotNull(), "has_header").when(F.col("index_entries") > 0, "has_index")
    return devices.select("device_path", fault.alias("fault"))


def merge_pool(stored: DataFrame, running: DataFrame) -> DataFrame:
    """The pool with running devices in place of stored ones of the same id; missing ones stay. changed marks new values."""
    s, r = (df.groupBy("disk_id").agg(F.min("device_path").alias("device_path")) for df in (stored, running))
    x = s.withColumnRenamed("device_path", "old").join(r.withColumnRenamed("device_path", "new"), "disk_id", "full_outer")
    return x.select("disk_id", F.coalesce("new", "old").alias("device_path"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def newest_snapshots(files: DataFrame) -> DataFrame:
    """One snapshot file per disk, a compressed one before a raw one."""
    ranked = F.row_number().over(W.partitionBy("disk_id").orderBy(F.col("is_zst").desc(), "path"))
    return files.withColumn("rn", ranked).where("rn = 1").drop("rn")


def snapshot_faults(snapshots: DataFrame) -> DataFrame:
    """(disk_id, fault): small, alignment, header, length, checksum, no_meta (a compressed one needs its side file).

    snapshots: disk_id, is_zst, size_bytes, version, header_id, meta_size, meta_sha256, sha256.
    """
    fault = (
        F.when(F.col("size_bytes") <= GRID_START, "small")
        .when(F.col("size_bytes") % SLOT_BYTES != 0, "alignment")
        .when(F.coalesce(F.col("version") != HEADER_VERSION, F.lit(True)) | ~F.col("header_id").eqNullSafe(F.col("disk_id")), "header")
        .when(F.col("is_zst") & F.col("meta_sha256").isNull(), "no_meta")
        .when(F.col("meta_size") != F.col("size_bytes"), "length")
        .when(F.col("meta_sha256") != F.col("sha256"), "checksum")
    )
    return snapshots.select("disk_id", fault.alias("fault"))


def changed_snapshots(current: DataFrame, stored: DataFrame) -> DataFrame:
    """The disks whose (size, sha256) differs from their last snapshot, or that have none."""
    return current.join(stored.select("disk_id", "size_bytes", "sha256").distinct(), ["disk_id", "size_bytes", "sha256"], "left_anti")


def restore_pool(configured: DataFrame, live: DataFrame, snapshots: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(disk_id, source, device_path, warning): where each disk of the pool comes from.

    Ordinary disks pass through. Of the zram disks (configured or with a snapshot) a live
    one wins, else its snapshot is restored, else it is missing with a warning. An id that
    an ordinary disk also has is a conflict.
    """
    ids = configured.select("disk_id").unionByName(snapshots.select("disk_id")).distinct()
    x = ids.join(live.groupBy("disk_id").agg(F.min("device_path").alias("live")), "disk_id", "left")
    x = x.join(snapshots.groupBy("disk_id").agg(F.min("path").alias("snap")), "disk_id", "left")
    x = x.join(ordinary.groupBy("disk_id").agg(F.min("device_path").alias("ord")), "disk_id", "full_outer")
    zram = F.col("live").isNotNull() | F.col("snap").isNotNull()
    source = F.when(F.col("ord").isNotNull() & zram, "conflict").when(F.col("ord").isNotNull(), "ordinary").when(F.col("live").isNotNull(), "live").when(F.col("snap").isNotNull(), "snapshot").otherwise("missing")
    return x.select("disk_id", source.alias("source"), F.coalesce("ord", "live", "snap").alias("device_path"), (source == "missing").alias("warning"))

"""Periodic jobs: maintenance that runs beside a store, as a triggered stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def every(spark: SparkSession, seconds: float, job: Callable[[int], None]) -> StreamingQuery:
    """Runs job(n) each `seconds`, one at a time; a run that takes longer delays the next. A job that fails is named in the query's exception and ends it."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(_: DataFrame, batch: int) -> None:
        job(batch)

    return ticks.writeStream.foreachBatch(run).trigger(processingTime=f"{seconds} seconds").start()


def trim_job(disks: Callable[[], DataFrame], trim: Callable[[int], None], report: Callable[[int, Exception], None]) -> Callable[[int], None]:
    """A job that trims every writable disk (disk_id, slots, faulted) in turn; a disk whose trim fails is reported, the others go on."""
    from ..operators.placement import can_write

    def run(_: int) -> None:
        d = disks()
        for r in d.where(can_write(F.lit(1), F.col("slots"), F.col("faulted"))).select("disk_id").orderBy("disk_id").collect():  # a catalog
            try:
                trim(r["disk_id"])
            except Exception as e:  # noqa: BLE001
                report(r["disk_id"], e)

    return run

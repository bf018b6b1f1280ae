"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import formats, general, logs, pool, store  # noqa: F401


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return store.fid_dedup(spark, d)


def queries() -> dict:
    return general.QUERIES | store.QUERIES


def oracle_sql() -> dict[str, str]:
    return general.ORACLE | store.ORACLE

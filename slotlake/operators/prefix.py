"""Running sums that no hot group can push into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def blocked_running_sum(df: DataFrame, group: list[str], block: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the group before this one.

    `block` must rise with `order` inside a group. Rows are shuffled once, by
    (group, block), so a group that holds a third of all rows is spread over its
    blocks; only one total per block goes through the per-group window.
    Null values count as 0, a null block as block 0. An empty table stays empty.
    """
    keys = [*group, "_block"]
    # A block that cannot be null keeps the join from adding a filter below the shuffles,
    # so that both branches read the same ones.
    block = F.coalesce(block.cast("long"), F.lit(0).cast("long"))
    rows = df.withColumn("_block", block)
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    v = F.coalesce(F.col(value), F.lit(0))
    rows = rows.withColumn("_inner", F.sum(v).over(w) - v)
    totals = df.select(*group, block.alias("_block"), F.coalesce(F.col(value), F.lit(0)).alias("_v")).groupBy(*keys).agg(F.sum("_v").alias("_total"))
    g = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*keys, F.coalesce(F.sum("_total").over(g), F.lit(0)).alias("_base"))
    return rows.join(base, keys).withColumn(out, F.col("_base") + F.col("_inner")).drop("_block", "_inner", "_base")

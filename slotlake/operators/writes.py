"""Write-side protocol as data: admission, deduplication, routing by size, chunk validation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..types import ATOMIC_LIMIT, MAX_PUT


def path_of(size: Column, cdc: bool = False, atomic: bool = False) -> Column:
    """cdc or atomic: chunked above 16 MiB unless told otherwise."""
    if cdc and atomic:
        raise ValueError("cdc and atomic exclude each other")
    if cdc or atomic:
        return F.lit("cdc" if cdc else "atomic")
    return F.when(size > ATOMIC_LIMIT, "cdc").otherwise("atomic")


def request_fault(max_put: int = MAX_PUT) -> Column:
    """Why a put request (fid, total_size, alias_for) is refused before any byte moves; null if it is not.

    alias_for null or 0 means none.
    """
    alias = F.nullif("alias_for", F.lit(0))
    size = F.col("total_size")
    return (
        F.when(F.col("fid").isNull(), "no_fid")
        .when(size.isNull() | (size <= 0), "empty")
        .when(alias == F.col("fid"), "self_alias")
        .when(alias.isNotNull() & (size < 2), "alias_too_small")
        .when(size > max_put, "too_large")
    )


def error_class(status: Column) -> Column:
    """conflict, not_found, resource_exhausted, invalid_argument or other, by a status text; null for ok and null."""
    code = F.split(status, ":")[0]
    named = F.when(code.isin("already_exists", "duplicate", "extent", "jump_exhausted"), "conflict").when(code.isin("not_found", "resource_exhausted", "invalid_argument"), code)
    return F.when(status.isNotNull() & (status != "ok"), F.coalesce(named, F.lit("other")))


def atomic_fault(size: Column) -> Column:
    """Why an atomic put of a payload is refused: empty, or too_large above 16 MiB; null if it is not."""
    return F.when(size.isNull() | (size <= 0), "empty").when(size > ATOMIC_LIMIT, "too_large")


def admit(requests: DataFrame, known: DataFrame | None = None, max_put: int = MAX_PUT) -> DataFrame:
    """(seq, fid, status): the first request of each fid is accepted, later ones are duplicates.

    Redelivered rows (same seq) count once. A fid that is already known is a duplicate
    from its first request. Refused requests do not reserve their fid. First arrivals come
    from a partial aggregate, so a fid with a third of all requests is no hot group.
    """
    one = requests.where("seq is not null").groupBy("seq").agg(F.min(F.struct("fid", "total_size", "alias_for")).alias("r")).select("seq", "r.*")
    one = one.withColumn("fault", request_fault(max_put))
    first = one.where("fault is null").groupBy("fid").agg(F.min("seq").alias("seq")).withColumn("first", F.lit(True))
    if known is not None:
        first = first.join(known.select("fid").distinct(), "fid", "left_anti")
    x = one.join(first.select("seq", "first"), "seq", "left")
    status = F.when(F.col("fault").isNotNull(), F.concat(F.lit("invalid_argument:"), "fault")).when(F.col("first"), "ok").otherwise("already_exists")
    return x.select("seq", "fid", status.alias("status"))


#: Requests that one task may decide in order.
IN_ORDER = 100_000


def gate(requests: DataFrame, taken: DataFrame, in_order: int = IN_ORDER) -> DataFrame:
    """Requests (seq, fid, alias_for) with granted: all of {fid, alias} free of taken fids and of earlier granted ones.

    A refused request holds none of its keys. A request of a single key leaves that key
    held, whether it is granted or not, so all later ones are refused at once: what is left
    to decide in order are requests of two keys and the single ones they meet. These are
    decided in rounds: the first on each of its keys is granted, those it meets are
    refused; the last `in_order` are decided by one task. alias_for null or 0 means none; a
    null fid is no key, and a request without a key is not granted. seq is unique.
    """
    pairs = requests.select("seq", F.array_distinct(F.array_compact(F.array("fid", F.nullif("alias_for", F.lit(0))))).alias("k")).select("seq", F.size("k").alias("n"), F.explode("k").alias("key"))
    info = pairs.where("n = 1").groupBy("key").agg(F.min("seq").alias("single")).unionByName(taken.where("fid is not null").select(F.col("fid").alias("key"), F.lit(-(2**63)).cast("long").alias("single")))
    info = info.groupBy("key").agg(F.min("single").alias("single"))
    x = pairs.join(info, "key", "left").withColumn("late", F.coalesce(F.col("single") < F.col("seq"), F.lit(False)))
    double = x.where("n = 2")
    open2 = double.join(double.where("late").select("seq"), "seq", "left_anti").select("seq", "key")
    open1 = x.where("n = 1 and not late").select("seq", "key")
    meets = open2.select("key").distinct()
    undecided = cut(open2.unionByName(open1.join(meets, "key", "left_semi")))
    granted = open1.join(meets, "key", "left_anti").select("seq")
    while undecided.limit(in_order + 1).count() > in_order:
        first = undecided.groupBy("key").agg(F.min("seq").alias("first"))
        won = cut(undecided.join(first, "key").groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("first")).alias("w")).where("w").select("seq"))
        held = undecided.join(won, "seq", "left_semi").select("key").distinct()
        decided = undecided.join(held, "key", "left_semi").select("seq").distinct()
        undecided = cut(undecided.join(decided, "seq", "left_anti"))
        granted = granted.unionByName(won)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"seq": [], "key": []}, dtype="int64")])
        held: set[int] = set()
        out = []
        for seq, keys in rows.groupby("seq", sort=True)["key"]:
            k = set(keys.tolist())
            if not k & held:
                held |= k
                out.append(seq)
        yield pd.DataFrame({"seq": pd.Series(out, dtype="int64")})

    granted = granted.unionByName(undecided.coalesce(1).mapInPandas(decide, "seq long"))
    return requests.join(granted.withColumn("granted", F.lit(True)), "seq", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def stream_faults(parts: DataFrame, totals: DataFrame) -> DataFrame:
    """(id, parts, bytes, total, fault) of uploads in parts: gap, short, long or null if whole.

    parts: id, idx, size (redelivered parts count once); totals: id, total.
    """
    one = parts.groupBy("id", "idx").agg(F.max("size").alias("size"))
    g = one.groupBy("id").agg(F.count(F.lit(1)).alias("parts"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.sum("size").alias("bytes"))
    x = totals.join(g, "id", "left")
    bytes_ = F.coalesce("bytes", F.lit(0))
    fault = F.when((F.col("lo") != 0) | (F.col("hi") + 1 != F.col("parts")), "gap").when(bytes_ < F.col("total"), "short").when(bytes_ > F.col("total"), "long")
    return x.select("id", F.coalesce("parts", F.lit(0)).alias("parts"), bytes_.alias("bytes"), "total", fault.alias("fault"))


def deduplicate(objects: DataFrame, order: str) -> DataFrame:
    """objects with first (the row of least `order` that has this fid) and is_duplicate; a null fid is no duplicate."""
    first = objects.where("fid is not null").groupBy("fid").agg(F.min(order).alias("first"))
    x = objects.join(first, "fid", "left")
    return x.withColumn("is_duplicate", F.coalesce(F.col(order) != F.col("first"), F.lit(False)))

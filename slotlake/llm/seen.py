"""Has this key been seen before? (problem 3)

Records of an origin are ordered by (id, pos). The order is cut into sealed batches;
generation 0 holds the keys known before. For every shard of keys and every sealed batch an
immutable fingerprint filter is built (see fuse). A batch's keys are asked of the
filters of all earlier batches of their shard; within the batch the first occurrence is
found exactly. Filters may answer yes wrongly, never no; each yes can be checked
exactly against the stored batches, which also measures the rate of wrong answers.

A key's rows collapse to one per batch before anything is shuffled by key, so a key
with a third of all rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse

#: Sealed batches the records are cut into at least, and records of a batch beyond that.
GENERATIONS = 8
BATCH_ROWS = 50_000_000
#: Records for which one shard of filters is added.
SHARD_ROWS = 250_000


def rows_of(puts: DataFrame | None, chunks: DataFrame | None) -> DataFrame:
    """(origin, id, pos, key): put requests (seq, 0) and chunks (file_id, idx) as they were delivered; those with a null id or pos are left out."""
    parts = []
    if puts is not None:
        parts.append(puts.select(F.lit("put_requests").alias("origin"), F.col("seq").alias("id"), F.lit(0).cast("long").alias("pos"), F.col("fid").alias("key")))
    if chunks is not None:
        parts.append(chunks.select(F.lit("chunks").alias("origin"), F.col("file_id").alias("id"), F.col("idx").cast("long").alias("pos"), F.col("fid").alias("key")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.where("id is not null and pos is not null")


def records_of(puts: DataFrame | None, chunks: DataFrame | None) -> DataFrame:
    """The rows_of() each once.

    Redelivered rows collapse; of copies with different fids the least non-null one
    counts. Rows with a null id or pos are left out: they have no place in the order.
    """
    return rows_of(puts, chunks).groupBy("origin", "id", "pos").agg(F.min("key").alias("key"))


def batch_bounds(records: DataFrame, generations: int = GENERATIONS) -> dict[str, list[int]]:
    """Per origin the ids at which a new batch begins: quantiles of the ids, so that batches have about equal rows. The origins are few and named by the caller."""
    marks = [k / generations for k in range(1, generations)]
    ends = records.groupBy("origin").agg(F.percentile_approx("id", F.array(*map(F.lit, marks)) if marks else F.lit(0.5), 10_000).alias("q")).collect()
    return {r["origin"]: sorted(set(r["q"])) if marks else [] for r in ends}


def first_of_batch(records: DataFrame, bounds: dict[str, list[int]], shards: int) -> DataFrame:
    """(shard, origin, key, gen, first): one row for each key of each batch. Null keys have no answer."""
    gen = F.lit(1)
    for origin, cuts in bounds.items():
        for k, at in enumerate(cuts):
            gen = F.when((F.col("origin") == origin) & (F.col("id") > at), k + 2).otherwise(gen)
    rows = records.where("key is not null").select("origin", "key", gen.cast("int").alias("gen"), F.struct("id", "pos").alias("at"))
    firsts = rows.groupBy("origin", "key", "gen").agg(F.min("at").alias("first"))
    return firsts.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "origin", "key", "gen", "first")


_FILTERS = "shard int, origin string, gen int, keys long, error_rate double, filter binary"


def seal(keys: DataFrame, bits: int = fuse.BITS) -> DataFrame:
    """The filters (shard, origin, gen, keys, error_rate, filter) over rows (shard, origin, gen, key)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (origin, gen), g in pdf.groupby(["origin", "gen"]):
            blob = fuse.build(g["key"].to_numpy(), bits)
            p = fuse.Probe(blob)
            out.append((int(pdf["shard"].iloc[0]), origin, int(gen), p.n, p.error_rate, blob))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FILTERS.split(", ")])

    return keys.select("shard", "origin", "gen", "key").groupBy("shard").applyInPandas(build, _FILTERS)


_ANSWERS = "shard int, origin string, key long, gen int, id long, pos long, maybe boolean, error_rate double"


def probe(firsts: DataFrame, filters: DataFrame) -> DataFrame:
    """Rows of first_of_batch with maybe (a filter of an earlier batch found the key) and the compounded error rate.

    Generation 0 of any origin holds the keys that every origin has seen before.
    """

    def ask(rows: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        probes = [(o, g, fuse.Probe(b)) for o, g, b in zip(blobs["origin"], blobs["gen"], blobs["filter"], strict=True)]
        parts = []
        for (origin, gen), g in rows.groupby(["origin", "gen"]):
            keys, rates = g["key"].to_numpy(), []
            maybe = np.zeros(len(g), dtype=bool)
            for o, n, p in probes:
                if n == 0 or o == origin and n < gen:
                    maybe |= p.contains(keys)
                    rates.append(p.error_rate)
            parts.append(g.assign(maybe=maybe, error_rate=fuse.compounded(rates)))
        columns = [c.split()[0] for c in _ANSWERS.split(", ")]
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)

    flat = firsts.select("shard", "origin", "key", "gen", "first.id", "first.pos")
    return flat.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(ask, _ANSWERS)


def _stages(records: DataFrame, known: DataFrame, rows: int, generations: int, bits: int, delivered: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    shards = max(8, -(-rows // SHARD_ROWS))
    bounds = batch_bounds(records if delivered is None else delivered, max(generations, -(-rows // BATCH_ROWS)))
    firsts = first_of_batch(records, bounds, shards)
    before = known.where("fid is not null").select(F.pmod(F.xxhash64("fid"), F.lit(shards)).cast("int").alias("shard"), F.lit("").alias("origin"), F.col("fid").alias("key"), F.lit(0).alias("gen")).distinct()
    return firsts, before, seal(firsts.select("shard", "origin", "key", "gen").unionByName(before), bits), sorted(bounds)


def _checked(firsts: DataFrame, before: DataFrame, filters: DataFrame, origins: list[str]) -> DataFrame:
    """probe() with seen: what an exact look into the stored batches says of each yes. A no stands.

    A key's earliest batch, per origin, is one row for each key, which the yes rows meet once.
    """
    asked = probe(firsts, filters)
    stored = firsts.select("origin", "key", "gen").unionByName(before.select("origin", "key", "gen"))
    earliest = stored.groupBy(F.col("key").alias("k")).agg(F.min("gen").alias("any"), *(F.min(F.when(F.col("origin") == o, F.col("gen"))).alias(f"gen_{i}") for i, o in enumerate(origins)))
    own = F.coalesce(*(F.when(F.col("origin") == o, F.col(f"gen_{i}")) for i, o in enumerate(origins)), F.lit(None).cast("int"))
    yes = asked.where("maybe").join(earliest, F.col("key") == F.col("k"), "left")
    yes = yes.select(*asked.columns, (F.coalesce(F.col("any") == 0, F.lit(False)) | F.coalesce(own < F.col("gen"), F.lit(False))).alias("seen"))
    return asked.where("not maybe").withColumn("seen", F.lit(False)).unionByName(yes)


def answers(records: DataFrame, known: DataFrame, rows: int, generations: int = GENERATIONS, bits: int = fuse.BITS, delivered: DataFrame | None = None) -> DataFrame:
    """(origin, id, pos, key, seen) for every record; seen is null for a null key.

    Only the first record of a key in a batch that no filter knows, or whose yes does
    not stand, is new; every other record with a key was seen. `rows` sizes the shards. The batches are cut by
    the ids of `delivered` (rows_of(), which need no shuffle) if given, else of the records.
    """
    firsts, before, filters, origins = _stages(records, known, rows, generations, bits, delivered)
    new = _checked(firsts, before, filters, origins).where("not seen").select("origin", "id", "pos", F.lit(True).alias("new"))
    joined = records.join(new, ["origin", "id", "pos"], "left")
    return joined.select("origin", "id", "pos", "key", F.when(F.col("key").isNotNull(), F.col("new").isNull()).alias("seen"))


def error_report(records: DataFrame, known: DataFrame, rows: int, generations: int = GENERATIONS, bits: int = fuse.BITS, delivered: DataFrame | None = None) -> DataFrame:
    """Per origin and batch: keys asked, expected compounded error rate, yes answers, wrong ones and their measured rate."""
    firsts, before, filters, origins = _stages(records, known, rows, generations, bits, delivered)
    wrong = F.count_if(F.col("maybe") & ~F.col("seen"))
    new = F.count_if(~F.col("seen"))
    return (
        _checked(firsts, before, filters, origins)
        .groupBy("origin", "gen")
        .agg(F.count(F.lit(1)).alias("keys"), F.max("error_rate").alias("expected_rate"), F.count_if("maybe").alias("yes"), wrong.alias("wrong_yes"), (wrong / F.greatest(new, F.lit(1))).alias("measured_rate"))
    )


class SealedBatches:
    """The same for a stream: batches come one by one, filters of sealed ones stay.

    Only filters (about 20 bits a key at 16-bit fingerprints) are kept for earlier batches.
    """

    def __init__(self, bits: int = fuse.BITS) -> None:
        self.bits, self.filters = bits, []

    def ask(self, keys: Iterable[int | None]) -> list[bool | None]:
        """Whether each key was seen, in order (None for a null key); then the batch is sealed."""
        given = list(keys)
        k = np.fromiter((x for x in given if x is not None), dtype=np.int64)
        seen = np.ones(len(k), dtype=bool)
        _, first = np.unique(k, return_index=True)
        seen[first] = False
        for p in self.filters:
            seen |= p.contains(k)
        self.filters.append(fuse.Probe(fuse.build(k, self.bits)))
        answers_ = iter(seen.tolist())
        return [None if x is None else next(answers_) for x in given]

    @property
    def error_rate(self) -> float:
        return fuse.compounded([p.error_rate for p in self.filters])


def seen_sink(path: str, shards: int = 8, bits: int = fuse.BITS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for a stream of (id, pos, key): answers go to path/answers, the sealed batch's filters to path/filters.

    A batch asks the filters of all batches before it; its own keys are decided exactly
    (the first in order of id and pos is new). Only filters are kept of earlier batches,
    so a yes may be wrong at error_rate. A batch that runs again overwrites what it wrote.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        records = df.select(F.lit("").alias("origin"), "id", "pos", "key")
        firsts = first_of_batch(records, {}, shards).withColumn("gen", F.lit(batch + 1))
        sealed = seal(firsts.select("shard", "origin", "gen", "key"), bits)
        earlier = spark.read.schema(_FILTERS).parquet(*(f"{path}/filters/batch={b}" for b in range(batch))) if batch else sealed.limit(0)
        asked = probe(firsts, earlier).where("not maybe").select("id", "pos", "key", F.lit(True).alias("new"))
        # A shard without an earlier filter answers no; the rate is that of a shard with all of them.
        rate = fuse.compounded([2.0**-bits] * batch)
        out = records.drop("origin").join(asked, ["id", "pos", "key"], "left")
        out.select("id", "pos", "key", F.when(F.col("key").isNotNull(), F.col("new").isNull()).alias("seen"), F.lit(rate).alias("error_rate")).write.mode("overwrite").parquet(f"{path}/answers/batch={batch}")
        sealed.write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")

    return write

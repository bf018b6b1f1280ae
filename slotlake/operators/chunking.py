"""Content-defined chunking and manifests.

FastCDC as published (gear hash, normalised chunking with two masks). The gear hash at a
byte depends on the 64 bytes before it only, so it is computed for a whole buffer in six
shift-and-add doublings; cut points are then picked from the few positions that match a
mask.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fid import content_fid
from ..types import CDC_SIZES

#: Normalisation level: bits added to and taken from the mask before and after the target size.
NORMAL = 2
_BLOCK = 1 << 22


def gear_table(seed: int = 0) -> np.ndarray:
    """256 random 64-bit values, by rule: XXH64 of the byte under the seed."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed=seed) for b in range(256)], dtype=np.uint64)


_GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash behind every byte, over a window of 64 bytes."""
    h = _GEAR[data]
    for k in range(6):
        step = 1 << k
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint64(step)
        h = h + shifted
    return h


def _mask(bits: int) -> np.uint64:
    """`bits` one-bits at the top of the hash, where the whole window has its say."""
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def cut_sizes(data: bytes, least: int, target: int, most: int) -> list[int]:
    """Sizes of the chunks of data, in order; all in [least, most] but the last."""
    if not 0 < least <= target <= most:
        raise ValueError("chunk sizes need 0 < least <= target <= most")
    n = len(data)
    if not n:
        return []
    bits = max(1, target.bit_length() - 1)
    raw = np.frombuffer(data, dtype=np.uint8)
    hard, easy = [], []
    for lo in range(0, n, _BLOCK):
        begin = max(0, lo - 63)
        h = gear_hashes(raw[begin : lo + _BLOCK])[lo - begin :]
        easy.append(np.flatnonzero((h & _mask(max(1, bits - NORMAL))) == 0) + lo + 1)
        hard.append(np.flatnonzero((h & _mask(min(63, bits + NORMAL))) == 0) + lo + 1)
    hard, easy = np.concatenate(hard), np.concatenate(easy)
    sizes, start = [], 0
    while start < n:
        if n - start <= least:
            sizes.append(n - start)
            break
        middle, last = min(start + target, n), min(start + most, n)
        i = int(np.searchsorted(hard, start + least))
        cut = int(hard[i]) if i < len(hard) and hard[i] < middle else 0
        if not cut:
            i = int(np.searchsorted(easy, max(middle, start + least)))
            cut = int(easy[i]) if i < len(easy) and easy[i] <= last else last
        sizes.append(cut - start)
        start = cut
    return sizes


_CHUNKS = "file_id long, idx int, fid long, byte_offset long, size long, payload binary"


def chunk(files: DataFrame, least: int = CDC_SIZES[0], target: int = CDC_SIZES[1], most: int = CDC_SIZES[2]) -> DataFrame:
    """chunks of files (file_id, payload). Null and empty payloads give none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file_id, data in zip(b["file_id"], b["payload"], strict=True):
                data, at = bytes(data), 0
                for k, size in enumerate(cut_sizes(data, least, target, most)):
                    part = data[at : at + size]
                    rows.append((file_id, k, content_fid(part), at, size, part))
                    at += size
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CHUNKS.split(", ")])

    return files.select("file_id", "payload").where("payload is not null and file_id is not null").mapInPandas(cut, _CHUNKS)


def fixed_chunks(files: DataFrame, size: int) -> DataFrame:
    """(file_id, idx, byte_offset, size, payload) of chunks of one size; the control for chunk(). Stays in the JVM."""
    n = F.octet_length("payload")
    x = files.where(n > 0).select("file_id", "payload", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(size))).alias("idx", "at"))
    part = F.substring(F.col("payload"), F.col("at") + 1, F.lit(size))
    return x.select("file_id", "idx", F.col("at").cast("long").alias("byte_offset"), F.octet_length(part).cast("long").alias("size"), part.alias("payload"))


def contiguity_faults(chunks: DataFrame) -> DataFrame:
    """(file_id, idx, byte_offset, expected): chunks that do not begin where those before them end.

    Redelivered chunks count once. Long files are summed in blocks of idx.
    """
    from .prefix import blocked_running_sum

    one = chunks.where("file_id is not null and idx is not null").groupBy("file_id", "idx").agg(F.max("byte_offset").alias("byte_offset"), F.max("size").alias("size"))
    x = blocked_running_sum(one, ["file_id"], F.floor(F.col("idx") / 4096), [F.col("idx")], "size", "expected")
    return x.where("byte_offset is not null and byte_offset != expected").select("file_id", "idx", "byte_offset", "expected")


def manifests(chunks: DataFrame) -> DataFrame:
    """(file_id, total_size, chunks) with the chunks in order of offset: one row per file.

    A manifest is one object and lists the file's chunk descriptors (no payloads); chunks
    of 16 MiB keep it far below max_put.
    """
    one = chunks.where("file_id is not null and idx is not null").groupBy("file_id", "idx").agg(F.max(F.struct("fid", "byte_offset", "size")).alias("c"))
    d = F.struct(F.col("c.byte_offset").alias("byte_offset"), F.col("idx").alias("idx"), F.col("c.fid").alias("fid"), F.col("c.size").alias("size"))
    g = one.groupBy("file_id").agg(F.sum("c.size").alias("total_size"), F.sort_array(F.collect_list(d)).alias("chunks"))
    return g


def inspect(manifests_: DataFrame) -> DataFrame:
    """(file_id, no, fid, byte_offset, size): manifests flattened."""
    return manifests_.select("file_id", F.posexplode("chunks").alias("no", "c")).select("file_id", F.col("no").cast("long").alias("no"), "c.fid", "c.byte_offset", "c.size")


def sparse_range(manifests_: DataFrame, ranges: DataFrame, bucket: int = 1 << 24) -> DataFrame:
    """(req_id, file_id, no, fid, skip, take): the chunks a range touches, and which of their bytes.

    ranges: req_id, file_id, range_start, range_end; end 0, null or beyond means the end. An
    empty or inverted range touches nothing, without error. Chunks without offset or size
    have no place and are skipped. Chunks and ranges meet in buckets of the file's bytes,
    an equi-join of narrow rows: a range never carries a file's whole list, and a file
    with a third of all chunks is many keys. Chunks are pruned before any payload is joined.
    """
    c = manifests_.select("file_id", F.posexplode("chunks").alias("no", "c")).where("c.byte_offset is not null and c.size > 0").select("file_id", "no", F.col("c.fid").alias("fid"), F.col("c.byte_offset").alias("a"), (F.col("c.byte_offset") + F.col("c.size")).alias("b"))
    c = c.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket), F.floor((F.col("b") - 1) / bucket))))
    r = ranges.select("req_id", "file_id", F.coalesce("range_start", F.lit(0)).alias("s"), "range_end").join(manifests_.select("file_id", "total_size"), "file_id")
    end = F.when(F.col("range_end").isNull() | (F.col("range_end") == 0) | (F.col("range_end") > F.col("total_size")), F.col("total_size")).otherwise(F.col("range_end"))
    r = r.select("req_id", "file_id", "s", end.alias("e")).where("e > s")
    r = r.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))))
    lo, hi = F.greatest("s", "a"), F.least("e", "b")
    x = r.join(c, ["file_id", "bucket"]).where((hi > lo) & (F.col("bucket") == F.floor(lo / bucket)))
    return x.select("req_id", "file_id", F.col("no").cast("long").alias("no"), "fid", (lo - F.col("a")).alias("skip"), (hi - lo).alias("take"))


def read_sparse(touched: DataFrame, chunks: DataFrame) -> DataFrame:
    """(req_id, data, missing) of sparse_range() rows: their slices end to end; missing counts chunks that are absent or too short."""
    from .reads import byte_slice, joined

    c = chunks.select("fid", "payload").where("payload is not null").dropDuplicates(["fid"])
    x = touched.join(c, "fid", "left")
    ok = F.col("skip") + F.col("take") <= F.octet_length("payload")
    x = x.select("req_id", "no", F.when(ok, byte_slice(F.col("payload"), F.col("skip"), F.col("skip") + F.col("take"))).alias("part"))
    lost = x.groupBy("req_id").agg(F.count_if(F.col("part").isNull()).alias("missing"))
    return joined(x, ["req_id"], "no", "part").join(lost, "req_id")


def dedup_ratio(base: DataFrame, other: DataFrame) -> DataFrame:
    """(chunks, found, ratio): how many distinct chunk fids of base occur in other."""
    b = base.where("fid is not null").select("fid").distinct()
    o = other.where("fid is not null").select("fid").distinct().withColumn("hit", F.lit(1))
    x = b.join(o, "fid", "left").agg(F.count(F.lit(1)).alias("chunks"), F.count("hit").alias("found"))
    return x.select("chunks", "found", (F.col("found") / F.greatest("chunks", F.lit(1))).alias("ratio"))

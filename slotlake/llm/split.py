"""Splitting oversized chunks at natural boundaries (problem 1).

A payload is read as tokens (a run of non-space bytes with the space after it). The
prefix sums of the token lengths are the sorted offsets at which a piece may begin; the
boundary arrays are the offsets that also begin a paragraph, a line or a sentence. For
each piece the last boundary under the limit is found by binary search, best kind
first; without any, the piece is cut hard at the limit, moved back out of a character.
The next piece begins overlap bytes before the cut, moved back to the start of a
character, so it repeats at least the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prefix import blocked_running_sum
from ..session import broadcast_if_small

#: Defaults of a profile whose values are null, zero or negative (a zero overlap is a real zero).
MAX_BYTES = 4096
OVERLAP_BYTES = 128
#: idx values per block of the running sum over a file's chunks.
FILE_BLOCK = 4096

_TOKEN = re.compile(rb"\s*\S+\s*|\s+")
#: Ends of sentences: Latin, CJK full stop, fullwidth ! and ?, Devanagari danda, Arabic question mark; and bytes of closing quotes and brackets.
_STOPS = (b".", b"!", b"?", b";", b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f", b"\xe0\xa5\xa4", b"\xd8\x9f")
_CLOSING = b"\"')]\xc2\xbb\xe2\x80\x99\x9d"
_WIDE_END = re.compile(rb"\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xe0\xa5\xa4")


def char_start(data: bytes, at: int) -> int:
    """`at`, moved back if it lies inside a valid UTF-8 character."""
    for back in range(1, 4):
        if at - back < 0 or not 0 < at < len(data) or data[at] & 0xC0 != 0x80:
            return at
        lead = data[at - back]
        if lead & 0xC0 == 0x80:
            continue
        width = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
        try:
            whole = len(data[at - back : at - back + width].decode("utf-8")) == 1
        except UnicodeDecodeError:
            return at
        return at - back if whole and back < width else at
    return at


def boundaries(data: bytes) -> list[np.ndarray]:
    """Sorted offsets that begin a paragraph, a line, a sentence, a token: best kind first."""
    tokens = _TOKEN.findall(data)
    ends = np.fromiter(accumulate(map(len, tokens)), dtype=np.int64, count=len(tokens))
    # The kind of a token's end is told by the space behind it, which is looked at once.
    spaced, sentences, lines, paragraphs = [], [], [], []
    for i, t in enumerate(tokens):
        if not t[-1:].isspace():
            continue
        spaced.append(i)
        word = t.rstrip()
        if word.rstrip(_CLOSING).endswith(_STOPS):
            sentences.append(i)
        space = t[len(word) :]
        if b"\n" in space:
            lines.append(i)
            if b"\n\n" in space.translate(None, b" \t\r"):
                paragraphs.append(i)
    wide = np.fromiter((m.end() for m in _WIDE_END.finditer(data)), dtype=np.int64)
    kinds = [ends[paragraphs], ends[lines], np.union1d(ends[sentences], wide), ends[spaced]]
    return [k.astype(np.int64) for k in kinds]


def cut_points(data: bytes | None, length: int, limit: int, overlap: int, least: int) -> list[tuple[int, int]]:
    """(offset, size) of the pieces. Without data (the payload is not kept) all cuts are hard.

    Any overlap below the limit is kept; one that is not below it cannot be, and counts as
    half the limit. Pieces repeat up to 3 bytes more to begin at a character. Where limit
    and overlap leave no room for a whole character, pieces repeat less, and a character
    wider than the limit is cut.
    """
    if length <= limit:
        return [(0, length)]
    overlap = overlap if overlap < limit else limit // 2
    least = max(1, min(least, limit // 2))
    kinds = boundaries(data) if data is not None else []
    whole = (lambda at: char_start(data, at)) if data is not None else (lambda at: at)
    pieces, start = [], 0
    while length - start > limit:
        high, cut = start + limit, 0
        # A boundary before the least fill is still better than a hard cut; the next piece must begin behind this one's start.
        for bottom in (start + max(least, overlap + 1), start + overlap + 1):
            for offsets in kinds:
                i = int(np.searchsorted(offsets, high, side="right")) - 1
                if i >= 0 and offsets[i] >= bottom and whole(int(offsets[i]) - overlap) > start:
                    cut = int(offsets[i])
                    break
            if cut:
                break
        if not cut:
            cut = whole(high)
            cut = cut if cut > start else high
        following = whole(cut - overlap) if overlap else cut
        if following <= start:
            following = start + 1
            while following < cut and whole(following) <= start:
                following += 1
        pieces.append((start, cut - start))
        start = following
    pieces.append((start, length - start))
    return pieces


def _positive(c: str, default: int) -> Column:
    return F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(default)).cast("long")


def with_limits(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """Chunks with length, max_bytes, overlap and least. Profiles are unique by id; of repeated ones the least values count."""
    o = options.where("profile_id is not null").groupBy("profile_id").agg(*(F.min(c).alias(f"_{c}") for c in ("max_chunk_size", "overlap_bytes", "min_chunk_size")))
    x = chunks.select("file_id", "idx", "fid", "byte_offset", "size", "payload", "profile_id").join(broadcast_if_small(o), "profile_id", "left")
    limit = _positive("_max_chunk_size", MAX_BYTES)
    overlap = F.when(F.col("_overlap_bytes") >= 0, F.col("_overlap_bytes")).otherwise(F.lit(OVERLAP_BYTES)).cast("long")
    return x.select(
        "file_id",
        "idx",
        "fid",
        "byte_offset",
        F.coalesce(F.octet_length("payload").cast("long"), F.col("size")).alias("length"),
        "payload",
        limit.alias("max_bytes"),
        overlap.alias("overlap"),
        F.when(F.col("_min_chunk_size") > 0, F.col("_min_chunk_size")).otherwise(F.floor(limit / 4)).cast("long").alias("least"),
    )


_PIECES = T.ArrayType(T.StructType([T.StructField("piece_offset", T.LongType()), T.StructField("piece_size", T.LongType())]))


@F.pandas_udf(_PIECES)
def cuts_udf(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """(payload, length, max_bytes, overlap, least) -> the pieces. Only these columns go through Python."""
    for payload, length, limit, overlap, least in batches:
        yield pd.Series(
            [[{"piece_offset": o, "piece_size": s} for o, s in cut_points(None if p is None else bytes(p), int(n), int(m), int(v), int(k))] for p, n, m, v, k in zip(payload, length, limit, overlap, least, strict=True)],
            dtype=object,
        )


def oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """The chunks longer than the maximum of their profile, each (file_id, idx) once.

    Length is that of the payload, or size where the payload is null. Only oversized rows
    are shuffled. Copies of a chunk are the same but for nulls; of copies that differ,
    the longest with a payload counts. Rows without file_id or idx are kept apart from
    each other only by the other part of the key.
    """
    over = with_limits(chunks, options).where(F.col("length") > F.col("max_bytes"))
    best = F.max_by(F.struct("fid", "byte_offset", "length", "payload", "max_bytes", "overlap", "least"), F.struct(F.col("payload").isNotNull(), "length", F.xxhash64("payload"), "fid", "byte_offset"))
    return over.groupBy("file_id", "idx").agg(best.alias("r")).select("file_id", "idx", "r.*")


def cut_oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """One row per oversized chunk with its cuts (piece_offset, piece_size), offsets from the chunk's start."""
    return oversized(chunks, options).withColumn("cuts", cuts_udf("payload", "length", "max_bytes", "overlap", "least")).drop("least")


def file_offsets(chunks: DataFrame) -> DataFrame:
    """(file_id, idx, true_offset): where each chunk begins by the lengths of those before it.

    Null where a chunk before it is missing or has no length. Narrow rows only; a file
    with a third of all chunks is spread over blocks of idx.
    """
    n = F.coalesce(F.octet_length("payload").cast("long"), F.col("size"))
    one = chunks.where("file_id is not null and idx is not null").groupBy("file_id", "idx").agg(F.max(n).alias("n")).withColumn("known", F.when(F.col("n").isNotNull(), 1).otherwise(0))
    block = F.floor(F.col("idx") / FILE_BLOCK)
    summed = blocked_running_sum(one, ["file_id"], block, [F.col("idx")], "n", "at")
    summed = blocked_running_sum(summed, ["file_id"], block, [F.col("idx")], "known", "before")
    return summed.select("file_id", "idx", F.when(F.col("before") == F.col("idx"), F.col("at")).alias("true_offset"))


def split_oversized(chunks: DataFrame, options: DataFrame) -> DataFrame:
    """The pieces of every oversized chunk: file_id, idx, piece_no, byte_offset, piece_offset, size, payload.

    byte_offset is the piece's place in the file: from the lengths of the chunks before
    it, else from the chunk's own byte_offset, else null. payload is null where the
    chunk's is. Empty tables give no pieces.
    """
    cuts = cut_oversized(chunks, options)
    p = cuts.select("file_id", "idx", "byte_offset", "payload", F.posexplode("cuts").alias("piece_no", "cut"))
    p = p.join(file_offsets(chunks), ["file_id", "idx"], "left")
    return p.select(
        "file_id",
        "idx",
        "piece_no",
        (F.coalesce("true_offset", "byte_offset") + F.col("cut.piece_offset")).alias("byte_offset"),
        F.col("cut.piece_offset").alias("piece_offset"),
        F.col("cut.piece_size").alias("size"),
        F.substring(F.col("payload"), (F.col("cut.piece_offset") + 1).cast("int"), F.col("cut.piece_size").cast("int")).alias("payload"),
    )

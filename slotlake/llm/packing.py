"""Filling fixed-capacity containers with documents (problem 5).

First-fit decreasing, run independently in randomised groups of bounded size. The bins
of a group lie in the leaves of a tournament tree whose inner nodes hold the larger
free room of their children, so the first bin with enough room is found by one
descent. Only (row, tokens) reach a group, never texts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers and the file in use.
TOKENIZERS = os.environ.get("SLOTLAKE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of these ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Documents per randomised group, on average.
GROUP_ROWS = 32_768

_ENCODERS: dict = {}


def encoder(folder: str = TOKENIZERS, name: str = RANKS):
    """The tokenizer of a rank file, once per process."""
    import tiktoken

    if (folder, name) not in _ENCODERS:
        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[folder, name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[folder, name]


def token_counter(folder: str = TOKENIZERS, name: str = RANKS):
    """A pandas UDF string -> number of tokens. Null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(folder, name).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (0 <= size <= capacity), bins numbered as they open."""
    n = len(sizes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    bins_most = min(n, 2 * int(-(-sizes.sum() // capacity)) + 1)  # at most one bin is not more than half full
    leaves = 1 << max(0, (bins_most - 1).bit_length())
    room = [capacity] * (2 * leaves)
    out = np.zeros(n, dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        s, node = int(sizes[i]), 1
        while node < leaves:
            node += node
            if room[node] < s:
                node += 1
        out[i] = node - leaves
        left = room[node] - s
        room[node] = left
        while node > 1:
            other = room[node ^ 1]
            node >>= 1
            left = left if left > other else other
            if room[node] == left:
                break
            room[node] = left
    return out


def pack(items: DataFrame, rows: int, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 11) -> DataFrame:
    """(id, piece_no, token_start, tokens, group_no, bin_no) of items (id, tokens).

    An item larger than the capacity is cut into full pieces and a rest; no other is
    split. Items without tokens take no room but get a bin; null ids are kept. Groups are drawn by a hash of
    id, tokens and the number of the copy, so repeated ids spread too and the groups do not
    hang on how the rows lie. `rows` (the number of items) only
    sets the number of groups; an empty table gives no rows.
    """
    groups = max(1, -(-rows // group_rows))
    tokens = F.coalesce(F.col("tokens"), F.lit(0))
    pieces = F.greatest(F.ceil(tokens / capacity), F.lit(1))
    # A null id travels as a flag: pandas would turn the whole column into floats.
    copies = items.select("id", tokens.alias("tokens")).groupBy("id", "tokens").agg(F.count(F.lit(1)).alias("n")).select("id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    cut = copies.select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("id").isNotNull().alias("named"), F.col("tokens").alias("t"), F.pmod(F.xxhash64("id", "tokens", "copy", F.lit(seed)), F.lit(groups)).cast("int").alias("group_no"), F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)).alias("piece_no"))
    cut = cut.select("group_no", "id", "named", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.least(F.col("t") - F.col("piece_no") * capacity, F.lit(capacity).cast("long")).alias("tokens"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "id", "piece_no"], ascending=[False, True, True], kind="stable")
        return pdf.assign(bin_no=first_fit_decreasing(pdf["tokens"].to_numpy(), capacity))

    filled = cut.groupBy("group_no").applyInPandas(fill, "group_no int, id long, named boolean, piece_no long, token_start long, tokens long, bin_no long")
    return filled.withColumn("id", F.when(F.col("named"), F.col("id"))).drop("named")


def pack_documents(documents: DataFrame, rows: int, capacity: int = CAPACITY, folder: str = TOKENIZERS, name: str = RANKS) -> DataFrame:
    """pack() of documents (doc_id, text) by their tokens."""
    items = documents.select(F.col("doc_id").alias("id"), token_counter(folder, name)("text").alias("tokens"))
    return pack(items, rows, capacity).withColumnRenamed("id", "doc_id")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: bins, tokens, share of the room filled, and the least number of bins by volume."""
    bins = packed.groupBy("group_no", "bin_no").agg(F.sum("tokens").alias("used"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    return bins.agg(F.count(F.lit(1)).alias("bins"), total.alias("tokens"), (total / F.greatest(F.count(F.lit(1)) * capacity, F.lit(1))).alias("fill"), F.ceil(total / capacity).alias("least_bins"))

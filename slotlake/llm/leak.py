"""Evaluation texts leaking into training text (problem 6): latent semantic retrieval.

1. Every document is cleaned of markup, case-folded and read as words; the words that
   occur in any test item are kept as (term, position), a compact code written once to
   the shared folder. Document frequencies over tiles of TILE words come with it.
2. A latent space: randomised SVD of the TF-IDF matrix of tiles, with the items as
   heavily weighted rows so that the space cannot lose what only they say. The range
   finder and the projection run distributed over a bounded sample of documents; only
   term x rank sums reach the driver.
3. Every passage (neighbouring tiles, at every tile, in lengths that follow those of the
   items) of every document is projected and compared with every item by cosine.
4. Candidates are checked by the longest common subsequence of words in a window little
   longer than the item, and by the answer-bearing words (names and numbers) among the
   words in common, which parts a leak from a text that only shares its glue words;
   words in common that stand side by side in long runs need no names or numbers.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_at_end, shared_dir
from .text import byte_words, characters

#: Words per tile. Passages are powers of two of tiles long, as the items' lengths want it.
TILE = 32
#: Terms in more than this share of the tiles carry no weight.
COMMON = 0.05
#: Least cosine of a candidate.
COSINE = 0.6
#: Weight of the items' rows in the decomposed matrix, oversampling of its rank, tiles it is fitted on.
ITEM_WEIGHT = 30.0
OVERSAMPLE = 32
FIT_TILES = 60_000
#: Items that share a latent space; a larger set is handled in blocks, so memory does not grow with it.
ITEM_BLOCK = 256
#: Share of an item's words that makes a leak, window length over item length.
SHARE = 0.5
STRETCH = 1.25
#: Below this share (glue words alone can reach SHARE) this part of the answer words must be there too,
#: unless the words in common lie in runs of at least RUN words that stand side by side in both texts.
SURE = 0.58
ANSWERS = 0.35
RUN = 8

MARKUP = re.compile(r"<!--.*?-->|<ref[^>]*/>|<ref[^>]*>.*?</ref>|&\w+;|<[^>]*>|\{\{\w+\}\}", re.S)
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 or c == 95 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text without markup, case-folded, as UTF-8: what stands between spaces and punctuation."""
    return byte_words(MARKUP.sub(" ", characters(text)).casefold(), _SPACES)


def answer_words(text: str) -> set[bytes]:
    """Numbers, and capitalised words that do not begin a sentence, case-folded."""
    out, begin = set(), True
    for m in re.finditer(r"\w+|[.!?:]", MARKUP.sub(" ", characters(text))):
        w = m.group()
        if not w[0].isalnum() and w != "_":
            begin = True
            continue
        if any(c.isdigit() for c in w) or (w[0].isupper() and not begin):
            out.add(w.casefold().encode())
        begin = False
    return out


class Items:
    """The test items as term sequences. Items with a null id or without a word match nothing."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        kept = sorted({(int(i), t) for i, t in rows if i is not None and t and words(t)})
        self.ids = [i for i, _ in kept]
        texts = [t for _, t in kept]
        self.vocab: dict[bytes, int] = {}
        self.terms = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words(t)], dtype=np.int32) for t in texts]
        self.answers = [frozenset(self.vocab[w] for w in answer_words(t) if w in self.vocab) for t in texts]
        self.counts = np.zeros((len(kept), len(self.vocab)), dtype=np.float32)
        for r, terms in enumerate(self.terms):
            np.add.at(self.counts[r], terms, 1)
        self.has = self.counts > 0
        self.masks = []
        for terms in self.terms:
            m: dict[int, int] = {}
            for k, t in enumerate(terms.tolist()):
                m[t] = m.get(t, 0) | 1 << k
            self.masks.append(m)


def common_subsequence(mask: dict[int, int], n: int, terms: list[int]) -> int:
    """Length of the longest common subsequence with an item of n words, bit-parallel. All terms are the item's."""
    full = (1 << n) - 1
    v = full
    for b in map(mask.__getitem__, terms):
        u = v & b
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def spans(lengths: list[int]) -> list[int]:
    """Lengths of passages, in tiles, for items of these numbers of words: two powers of two each, the longer one at least the item's length."""
    out = set()
    for n in lengths:
        top = 2 if n <= TILE else max(4, 1 << (-(-n // TILE) - 1).bit_length())
        out |= {top // 2, top}
    return sorted(out)


_CODED = "doc_id long, tiles long, terms binary, places binary, df binary"


def encode(documents: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """Per document its item terms and their word positions; per batch a row with the tile frequencies of the terms.

    Null and empty texts give a document without terms.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocab)
    size = len(vocab)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for b in batches:
            rows, marks, tiles = [], [], 0
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                w = words(text) if text else []
                ids = np.fromiter(map(get, w, repeat(-1)), dtype=np.int32, count=len(w))
                at = np.flatnonzero(ids >= 0).astype(np.int32)
                ids = ids[at]
                n = -(-len(w) // TILE)
                rows.append((doc_id, n, ids.tobytes(), at.tobytes(), None))
                marks.append((at // TILE + tiles).astype(np.int64) * size + ids)
                tiles += n
            if rows:
                pairs = np.sort(np.concatenate(marks))
                pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
                df = np.bincount(pairs % size, minlength=size)
                rows.append((None, tiles, None, None, df.astype(np.int64).tobytes()))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CODED.split(", ")]).astype({"doc_id": "Int64"})

    return documents.select("doc_id", "text").mapInPandas(code, _CODED)


def project(tiles: np.ndarray, terms: np.ndarray, weights: np.ndarray, basis: np.ndarray, count: int) -> np.ndarray:
    """Rows of A @ basis for the tiles 0..count-1, A being TF-IDF of the (tile, term) pairs in tile order."""
    out = np.zeros((count, basis.shape[1]), dtype=np.float32)
    heavy = weights[terms] > 0
    t, k = tiles[heavy], terms[heavy]
    if not len(t):
        return out
    scaled = (basis * weights[:, None]).astype(np.float32)
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    rank = np.arange(len(t)) - np.repeat(start, np.diff(np.r_[start, len(t)]))
    # The j-th terms of all tiles of a block are added at once; a block's rows stay in the cache.
    for lo in range(0, count, 1024):
        i, j = np.searchsorted(t, [lo, lo + 1024])
        order = np.argsort(rank[i:j], kind="stable")
        rows, cols = t[i:j][order] - lo, k[i:j][order]
        ends = np.cumsum(np.bincount(rank[i:j])) if j > i else []
        block, at = out[lo : lo + 1024], 0
        for end in ends:
            block[rows[at:end]] += scaled[cols[at:end]]
            at = end
    return out


def _coded_tiles(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, tile of each, number of tiles of each document, first tile of each) of a batch."""
    terms = np.frombuffer(b"".join(b["terms"]), dtype=np.int32)
    places = np.frombuffer(b"".join(b["places"]), dtype=np.int32)
    n = b["tiles"].to_numpy().astype(np.int64)
    first = np.cumsum(n) - n
    lengths = b["terms"].map(len).to_numpy() // 4
    return terms, places // TILE + np.repeat(first, lengths), n, first


def fit_space(coded: DataFrame, items: Items, weights: np.ndarray, tiles: int, fit_tiles: int = FIT_TILES, seed: int = 7) -> np.ndarray:
    """The latent basis (term x rank) by randomised SVD over a sample of about fit_tiles tiles and the weighted items."""
    size = len(items.vocab)
    rank = min(size, len(items.ids) + OVERSAMPLE)
    share = max(1, -(-tiles // fit_tiles))
    sample = coded.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)).select("tiles", "terms", "places")
    q = items.counts * weights
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    q *= ITEM_WEIGHT

    def gathered(basis: np.ndarray, back: bool) -> np.ndarray:
        """Sum over the sample of A'(A basis), or of (A basis)'(A basis)."""
        sent = coded.sparkSession.sparkContext.broadcast(basis)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b0, total = sent.value, None
            for b in batches:
                terms, tile, n, _ = _coded_tiles(b)
                y = project(tile, terms, weights, b0, int(n.sum()))
                norm = np.zeros(len(y))
                np.add.at(norm, tile, weights[terms] ** 2)
                y /= np.maximum(norm, 1e-9)[:, None] ** (1.0 if back else 0.5)
                if back:
                    order = np.argsort(terms, kind="stable")
                    order = order[weights[terms[order]] > 0]
                    z = np.zeros_like(b0)
                    for i in range(0, len(order), 200_000):
                        o = order[i : i + 200_000]
                        k = terms[o]
                        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                        if len(start):
                            z[k[start]] += np.add.reduceat(y[tile[o]], start, axis=0)
                    z *= weights[:, None].astype(np.float32)
                else:
                    z = y.T @ y
                total = z if total is None else total + z
            if total is not None:
                yield pd.DataFrame({"block": range(0, len(total), 512), "sums": [total[i : i + 512].astype(np.float32).tobytes() for i in range(0, len(total), 512)]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x, dtype=np.float32) for x in pdf["sums"]], axis=0, dtype=np.float64)
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [total.astype(np.float32).tobytes()]})

        parts = sample.mapInPandas(part, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").orderBy("block").collect()
        flat = np.concatenate([np.frombuffer(r["sums"], dtype=np.float32) for r in parts]) if parts else np.zeros(0, np.float32)
        shape = (size if back else rank, rank)
        sent.unpersist()
        return flat.reshape(shape) if len(flat) else np.zeros(shape, np.float32)

    omega = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)
    z = gathered(omega, True) + q.T @ (q @ omega)
    basis = np.linalg.qr(z.astype(np.float64))[0].astype(np.float32)
    p = q @ basis
    values, vectors = np.linalg.eigh((gathered(basis, False) + p.T @ p).astype(np.float64))
    return (basis @ vectors[:, np.argsort(-values)]).astype(np.float32)


_LEAKS = "doc_id long, item_id long, cosine double, share double, answers double"


def in_runs(item: np.ndarray, terms: np.ndarray, places: np.ndarray, least: int = RUN) -> np.ndarray:
    """Which words of a document stand in a run of at least `least` words that the item has side by side, too."""
    at: dict[int, list[int]] = {}
    for k, t in enumerate(item.tolist()):
        at.setdefault(t, []).append(k)
    out = np.zeros(len(terms), dtype=bool)
    before, last = {}, None
    for i, (t, p) in enumerate(zip(terms.tolist(), places.tolist(), strict=True)):
        now = {k: (before.get(k - 1, 0) if last is not None and p == last + 1 else 0) + 1 for k in at.get(t, ())}
        longest = max(now.values(), default=0)
        if longest >= least:
            out[i - longest + 1 : i + 1] = True
        before, last = now, p
    return out


def _accepted(items: Items, r: int, share: float, answers: float, terms: np.ndarray, places: np.ndarray) -> bool:
    """Whether a window whose words in common make `share` of item r is a leak, not glue."""
    if share >= SURE or share >= SHARE and answers >= ANSWERS:
        return True
    n = len(items.terms[r])
    return share >= SHARE and common_subsequence(items.masks[r], n, terms[in_runs(items.terms[r], terms, places)].tolist()) >= SHARE * n


def _check(items: Items, r: int, terms: np.ndarray, places: np.ndarray, lo: int, hi: int) -> tuple[bool, float, float]:
    """(accepted, share, answers) of item r in the words lo..hi of a document, in the best of the accepted windows, if any."""
    n, mask = len(items.terms[r]), items.masks[r]
    length = int(n * STRETCH)
    lo = max(0, lo - length)
    i, j = np.searchsorted(places, [lo, hi + length])
    terms, places = terms[i:j], places[i:j]
    own = items.has[r][terms]
    terms, places = terms[own], places[own]
    if len(terms) < SHARE * n or common_subsequence(mask, n, terms.tolist()) < SHARE * n:
        return False, 0.0, 0.0
    best, answers = (False, 0.0, 0.0), items.answers[r]
    begins = np.arange(lo, max(lo + 1, hi), 8)
    tried = None
    for a, b in zip(np.searchsorted(places, begins).tolist(), np.searchsorted(places, begins + length).tolist(), strict=True):
        # Every window that could be a leak is tested, not the fullest alone; after one is, only fuller ones.
        if (a, b) == tried or b - a < SHARE * n or best[0] and b - a <= best[1] * n:
            continue
        tried = (a, b)
        share = common_subsequence(mask, n, terms[a:b].tolist()) / n
        if share < SHARE or best[0] and share <= best[1]:
            continue
        held = len(answers.intersection(terms[a:b].tolist())) / len(answers) if answers else 1.0
        best = max(best, (_accepted(items, r, share, held, terms[a:b], places[a:b]), share, held))
    return best


def search(coded: DataFrame, items: Items, weights: np.ndarray, basis: np.ndarray, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, share, answers) of every candidate that the word checks confirm."""
    q = items.counts * weights @ basis
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    sent = coded.sparkSession.sparkContext.broadcast((items, weights, basis, q.astype(np.float32)))
    wanted = spans([len(t) for t in items.terms])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        its, w, b0, q0 = sent.value
        for big in batches:
            for at in range(0, len(big), 2000):
                b = big.iloc[at : at + 2000]
                terms, tile, n, first = _coded_tiles(b)
                lengths = b["terms"].map(len).to_numpy() // 4
                ends = np.cumsum(lengths)
                places = np.frombuffer(b"".join(b["places"]), dtype=np.int32)
                count = int(n.sum())
                y = project(tile, terms, w, b0, count)
                doc = np.repeat(np.arange(len(b)), n)
                hits: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
                # Sums over a power of two of tiles come from those over half as many.
                p, width = y, 1
                for span in wanted:
                    while width < span:
                        longer = p.copy()
                        if count > width:
                            longer[:-width] += p[width:] * (doc[:-width] == doc[width:])[:, None]
                        p, width = longer, 2 * width
                    c = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)) @ q0.T
                    for x, r in zip(*np.nonzero(c >= cosine), strict=True):
                        hits.setdefault((int(doc[x]), int(r)), []).append((int(x - first[doc[x]]), span, float(c[x, r])))
                out, ids = [], b["doc_id"].tolist()
                for (d, r), found in hits.items():
                    t, pl = terms[ends[d] - lengths[d] : ends[d]], places[ends[d] - lengths[d] : ends[d]]
                    best = (False, 0.0, 0.0)
                    regions: list[list[int]] = []
                    for x, span, _ in sorted(found):
                        if regions and x * TILE <= regions[-1][1]:
                            regions[-1][1] = max(regions[-1][1], (x + span) * TILE)
                        else:
                            regions.append([x * TILE, (x + span) * TILE])
                    for lo, hi in regions:
                        best = max(best, _check(its, r, t, pl, lo, hi))
                    if best[0]:
                        out.append((ids[d], its.ids[r], max(c for _, _, c in found), best[1], best[2]))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _LEAKS.split(", ")])

    return coded.where("doc_id is not null").select("doc_id", "tiles", "terms", "places").mapInPandas(find, _LEAKS)


def leaks(documents: DataFrame, eval_items: DataFrame, cosine: float = COSINE, fit_tiles: int = FIT_TILES, block: int = ITEM_BLOCK) -> DataFrame:
    """The documents that carry at least half of a test item as one passage, with each such item.

    eval_items is the held-out set; it passes the driver in blocks of `block` items, each
    with a latent space of its own. Each (doc_id, item_id) comes once, also for repeated
    rows of either table. No items or no documents give no rows; documents without doc_id
    are left out. The corpus, coded for a block, is written to the shared folder, which cuts
    the lineage for the three passes over it; it is deleted when the session ends.
    """
    found, held = documents.sparkSession.createDataFrame([], _LEAKS), []
    rows = eval_items.where("item_id is not null and text is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == block:
            found = found.unionByName(_leaks_of(documents, Items(held), cosine, fit_tiles))
            held = []
    if held:
        found = found.unionByName(_leaks_of(documents, Items(held), cosine, fit_tiles))
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "share", "answers")))


def _leaks_of(documents: DataFrame, items: Items, cosine: float, fit_tiles: int) -> DataFrame:
    """The leaks of one block of items."""
    spark = documents.sparkSession
    empty = spark.createDataFrame([], _LEAKS)
    if not items.ids:
        return empty
    path = f"{shared_dir(spark)}/leak-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    encode(documents.where("doc_id is not null"), items.vocab).write.option("compression", "zstd").parquet(path)
    coded = spark.read.schema(_CODED).parquet(path)
    size = len(items.vocab)
    counts = coded.where("doc_id is null").select("tiles", "df").mapInPandas(lambda it: _sum_df(it, size), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, dtype=np.int64)
    for r in counts:
        df[r["term"]] = r["n"]
    tiles, df = int(df[size]), df[:size]
    if not tiles:
        return empty
    weights = np.log((tiles + 1) / (df + 1.0))
    # In a corpus of a few tiles every term is common; then none is dropped.
    weights = np.where(df > max(COMMON * tiles, 50), 0.0, np.maximum(weights, 1e-3)).astype(np.float32)
    basis = fit_space(coded, items, weights, tiles, fit_tiles)
    return search(coded, items, weights, basis, cosine)


def _sum_df(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """(term, n) over the frequency rows of a partition; the number of tiles as term `size`."""
    total = np.zeros(size + 1, dtype=np.int64)
    for b in batches:
        total[size] += int(b["tiles"].sum())
        for x in b["df"]:
            total[:size] += np.frombuffer(x, dtype=np.int64)
    yield pd.DataFrame({"term": np.arange(size + 1, dtype=np.int32), "n": total})

"""Subject areas of documents (problem 7): a classifier chain decoded by beam search.

1. Term features. Labelled documents give sentences; an EM over the subjects of a
   document's labels and a background, per language, learns which words speak for which
   subject, with noisy and missing labels allowed for. Words that speak for one subject
   clearly become the lexicon.
2. Document features. Every sentence and table row is given the subject its words speak
   for, or none. Per subject: its share of the sentences that have a subject, also as
   the steps of SHARE_STEPS that it reaches, and its count; the part in tables (structure); the source.
3. Classifier chain. One logistic regression per subject over these features and the
   decisions on the subjects before it in the chain (co-occurrence), each calibrated on
   pages held out. The weights of a subject's own features are those of all subjects
   together plus a deviation. The targets are the raters' labels and nothing else: from
   which share on a subject is one of a document's, the chain learns from them. They are
   noisy, so the true label is a hidden variable: an EM finds the rates of missing and
   wrong labels with the chain.
4. A beam search over the chain finds the label combination of the highest joint probability.

The classifier is fitted on a bounded sample of labelled documents (FIT_DOCUMENTS, FIT_BYTES);
every document is classified, from its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import byte_words, characters

#: Most labelled documents the model is fitted on; those with the least hash of doc_id.
FIT_DOCUMENTS = 6_000
#: Most bytes of their texts: of the same order, those that still fit.
FIT_BYTES = 64 << 20
#: Labelled documents a source needs to be a feature; those of rarer sources have none.
SOURCE_DOCUMENTS = 20
#: EM rounds, and what a word needs to enter the lexicon: probability of its subject, expected sentences.
ROUNDS = 10
CLEAR = 0.75
#: Share of a word's sentences, by the labels alone, that its foremost subject must have.
TIED = 0.35
LEAST_SENTENCES = 2.0
#: Pages a word must be found on: one for this many labelled pages, at most LEAST_PAGES.
PAGES_PER_PAGE = 400
LEAST_PAGES = 8
#: Least evidence (log-odds) for a sentence to be about a subject.
EVIDENCE = 0.7
#: Steps of a subject's share of the sentences on a subject; the chain learns what each is worth.
SHARE_STEPS = 20
BEAM = 6
#: Rates of missing and of wrong labels that the cleaning of the raters' labels begins with, and its rounds.
MISSING, WRONG = 0.1, 0.01
CLEANINGS = 6
#: Ridge on the weights of all subjects together, and on what one link adds to them.
RIDGE, LINK_RIDGE = 1.0, 5.0
#: Pages are dealt into so many parts, the last of which is for calibration.
PARTS = 5

# Frequent words that tell the language of a sentence.
LANGUAGE_WORDS = {
    "en": "the of and was in to a with is as for had by which",
    "fr": "les des et à le la du un une que en dans sur",
    "de": "die der und aus von das den im zum nach ein sich",
    "es": "los las de en y el la un una que se del por",
}
LANGUAGES = tuple(LANGUAGE_WORDS)

_DROPPED = re.compile(
    r"<!--(?s:.*?)-->|<ref[^>]*/>|<ref[^>]*>(?s:.*?)</ref>|&\w+;|<[^>]*>|^=+[^=\n]*=+[ \t]*$|^\{\|.*$|^\|\+.*$|^\|[ \t]*\w[\w \t]*=(?![\x22]).*$|^!.*$|^#\w+ \[\[.*$"
    r"|\[\[(?:[Cc]ategory|[Kk]ategorie|[Cc]atégorie|[Cc]ategoría):[^\]]*\]\]|\{\{\w+(?:[ -]\w+)*(?:\|[^{}|=]*)?\}\}",
    re.M,
)
#: A pipe at the start of a line begins a table row or cell; it is kept as a mark of structure.
_ROW = re.compile(r"^\|(?!-|\})", re.M)
#: A sentence ends at its mark, or where a line ends before a blank one, a list item, a row or a heading. Other line ends are layout.
_END = re.compile(r"[.!?]+(?=\s|$|[\"'»)\]{])|\n(?=[ \t]*(?:[\x02\n*#:;|={!]|\Z))")
_SPACES = bytes(c if chr(c).isalpha() or c >= 128 or c in (1, 2) else 32 for c in range(256))
STOP, ROW = b"\x01", b"\x02"


def tokens(text: str | None) -> list[bytes]:
    """Case-folded words; STOP ends a sentence or row, ROW begins a table row. Null gives none."""
    if not text:
        return []
    t = _DROPPED.sub(" ", characters(text.replace("\x01", " ").replace("\x02", " ")))
    return byte_words(_END.sub(" \x01 ", _ROW.sub(" \x02 ", t)).casefold(), _SPACES)


class Lexicon:
    """Words that speak for a subject, with their weights per language and subject."""

    def __init__(self, words: list[bytes], weights: np.ndarray) -> None:
        """weights: language x word x subject."""
        self.index = {w: k for k, w in enumerate(words)}
        n = len(words)
        self.votes = np.zeros((n + 64, len(LANGUAGES)), dtype=np.float32)
        extra = []
        for j, lang in enumerate(LANGUAGES):
            for w in LANGUAGE_WORDS[lang].split():
                b = w.encode()
                if b not in self.index:
                    self.index[b] = n + len(extra)
                    extra.append(b)
                self.votes[self.index[b], j] += 1
        self.votes = self.votes[: n + len(extra)]
        self.weights = np.zeros((len(LANGUAGES), n + len(extra), weights.shape[2]), dtype=np.float32)
        self.weights[:, :n] = weights
        self.stop, self.row = n + len(extra), n + len(extra) + 1
        self.index[STOP], self.index[ROW] = self.stop, self.row

    def sentences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, subject, in a table) of every sentence that is about a subject."""
        get, subjects = self.index.get, self.weights.shape[2]
        codes, docs = [], []
        for k, text in enumerate(texts):
            t = tokens(text)
            if not t:
                continue
            c = np.fromiter(map(get, t, repeat(-1)), dtype=np.int32, count=len(t))
            codes.append(np.append(c[c >= 0], self.stop))
            docs.append(np.full(len(codes[-1]), k, dtype=np.int32))
        if not codes:
            z = np.zeros(0, dtype=np.int64)
            return z, z, z.astype(bool)
        code, doc = np.concatenate(codes), np.concatenate(docs)
        sentence = np.cumsum(code == self.stop) - (code == self.stop)
        count = int(sentence[-1]) + 1
        doc_of = np.zeros(count, dtype=np.int64)
        doc_of[sentence] = doc
        table = np.zeros(count, dtype=bool)
        table[sentence[code == self.row]] = True
        word = code < self.stop
        s, c = sentence[word], code[word]
        votes = np.stack([np.bincount(s, weights=self.votes[c, j], minlength=count) for j in range(len(LANGUAGES))], axis=1)
        # Rows of a table have no frequent words; their document's language counts.
        per_doc = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(per_doc, doc_of, votes)
        lang = np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), per_doc.argmax(axis=1)[doc_of])
        w = self.weights[lang[s], c]
        bearing = np.flatnonzero(w.any(axis=1))
        s, w = s[bearing], w[bearing]
        if not len(s):
            z = np.zeros(0, dtype=np.int64)
            return z, z, z.astype(bool)
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        total, at = np.add.reduceat(w, start, axis=0), s[start]
        about = total.max(axis=1) > EVIDENCE
        assert total.shape[1] == subjects
        return doc_of[at][about], total.argmax(axis=1)[about], table[at][about]


def learn_lexicon(texts: list[str], labels: np.ndarray, pages: list[int] | None = None) -> Lexicon:
    """The lexicon from texts and their (document x subject) 0/1 labels.

    pages tells which texts are revisions of one page: a word found on too few pages (a
    name, say) says nothing of other documents.
    """
    subjects = labels.shape[1]
    vocab: dict[bytes, int] = {}
    langs = {w.encode(): [j for j, x in enumerate(LANGUAGES) if w in LANGUAGE_WORDS[x].split()] for x in LANGUAGES for w in LANGUAGE_WORDS[x].split()}
    rows, cols, doc_of, sent_lang = [], [], [], []
    for d, text in enumerate(texts):
        sentences: list[list[bytes]] = [[]]
        for w in tokens(text):
            if w == STOP:
                sentences.append([])
            elif w != ROW:
                sentences[-1].append(w)
        known = np.zeros(len(LANGUAGES))
        votes = []
        for s in sentences:
            v = np.zeros(len(LANGUAGES))
            for w in s:
                for j in langs.get(w, ()):
                    v[j] += 1
            votes.append(v)
            known += v
        for s, v in zip(sentences, votes, strict=True):
            if not s:
                continue
            n = len(doc_of)
            for w in set(s):
                rows.append(n)
                cols.append(vocab.setdefault(w, len(vocab)))
            doc_of.append(d)
            sent_lang.append(int(v.argmax() if v.any() else known.argmax()))
    words, nlang = list(vocab), len(LANGUAGES)
    if not doc_of:
        return Lexicon([], np.zeros((nlang, 0, subjects)))
    rows, cols, doc, lang = np.array(rows), np.array(cols), np.array(doc_of), np.array(sent_lang)
    n = len(doc)
    # A term is a word in a language, found in at least three sentences.
    pair, term = np.unique(lang[rows].astype(np.int64) * len(words) + cols, return_inverse=True)
    page = np.asarray(range(len(texts)) if pages is None else pages)[doc[rows]]
    on = np.unique(np.stack([term, page]), axis=1)[0]
    least = min(LEAST_PAGES, max(1, round(len(np.unique(page)) / PAGES_PER_PAGE)))
    enough = (np.bincount(term) >= 3) & (np.bincount(on, minlength=len(pair)) >= least)
    renum = np.cumsum(enough) - 1
    keep = enough[term]
    rows, term, pair = rows[keep], renum[term[keep]], pair[enough]
    term_lang, term_word = pair // len(words), pair % len(words)
    prior = np.where(labels[doc] > 0, 1.0, 0.01)
    prior = np.hstack([0.8 * prior / prior.sum(axis=1, keepdims=True), np.full((n, 1), 0.2)])
    r, per_lang = prior.copy(), np.maximum(np.bincount(lang, minlength=nlang), 1)
    gather = lambda x, by, size: np.stack([np.bincount(by, weights=x[:, j], minlength=size) for j in range(x.shape[1])], axis=1)
    # Words of the sentence frames occur with all subjects. Left in, they would pull a whole
    # frame to one subject; only words that the labels themselves tie to a subject take part.
    first = gather(r[rows], term, len(pair))
    tied = first[:, :subjects].max(axis=1) >= TIED * first.sum(axis=1)
    keep = tied[term]
    rows, term = rows[keep], (np.cumsum(tied) - 1)[term[keep]]
    pair, term_lang, term_word = pair[tied], term_lang[tied], term_word[tied]
    if not len(pair):
        return Lexicon([], np.zeros((nlang, 0, subjects)))
    for _ in range(ROUNDS):
        c = gather(r[rows], term, len(pair))
        total = gather(r, lang, nlang)
        base = (c.sum(axis=1) / per_lang[term_lang])[:, None]
        weight = np.log((c + 2 * base) / (total[term_lang] + 2)) - np.log(base)
        z = gather(weight[term], rows, n) + np.log(prior)
        r = np.exp(z - z.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
    post = c / np.maximum(c.sum(axis=1, keepdims=True), 1e-12)
    clear = (post[:, :subjects].max(axis=1) >= CLEAR) & (c.sum(axis=1) >= LEAST_SENTENCES)
    used = np.unique(term_word[clear])
    number = np.full(len(words), -1)
    number[used] = np.arange(len(used))
    weights = np.zeros((nlang, len(used), subjects))
    speaks = np.clip(weight[:, :subjects], -3, 8) * (post[:, :subjects] > 0.15)
    weights[term_lang[clear], number[term_word[clear]]] = speaks[clear]
    return Lexicon([words[k] for k in used], weights)


def features(lexicon: Lexicon, texts: list[str | None], sources: list[str | None], known_sources: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document x feature, sentences on a subject per document)."""
    subjects, n = lexicon.weights.shape[2], len(texts)
    doc, subject, table = lexicon.sentences(texts)
    count = np.bincount(doc * subjects + subject, minlength=n * subjects).reshape(n, subjects)
    rows = np.bincount(doc[table] * subjects + subject[table], minlength=n * subjects).reshape(n, subjects)
    total = count.sum(axis=1)
    share = count / np.maximum(total, 1)[:, None]
    place = {s: k for k, s in enumerate(known_sources)}
    source = np.zeros((n, len(known_sources)))
    for k, s in enumerate(sources):
        if s in place:
            source[k, place[s]] = 1
    structure = np.stack([np.log1p(total), rows.sum(axis=1) / np.maximum(total, 1)], axis=1)
    return np.hstack([share, np.log1p(count), structure, source]), total


def _own(x: np.ndarray, k: int, subjects: int) -> np.ndarray:
    """The features of subject k: the steps its share reaches, the share, its count, and what is common to all subjects."""
    steps = x[:, [k]] * SHARE_STEPS + 1e-9 >= np.arange(1, SHARE_STEPS + 1)
    return np.hstack([steps, x[:, [k, subjects + k]], x[:, 2 * subjects :]])


def _logistic(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, ridge: np.ndarray | float = 1.0, free: float = 1e-3, start: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the constant, with the ridge `free`."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = free
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + offset, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


class Chain:
    """Logistic regressions in a row, each seeing the decisions before it, with calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray | None = None, linked: bool = True) -> None:
        """x: features; y: the raters' labels; held: the documents kept for calibration, each fifth if not given.

        linked: False leaves the earlier decisions out, to measure what they do.
        """
        self.subjects, self.linked = y.shape[1], linked
        self.order = np.argsort(-y.sum(axis=0), kind="stable").tolist()
        if held is None:
            held = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
        own = [_own(x, k, self.subjects) for k in range(self.subjects)]
        true, pooled = y.astype(float), None
        for turn in range(CLEANINGS):
            p, pooled = self._fit(own, true, held, pooled)
            missing = (true * (1 - y)).sum() / max(true.sum(), 1) if turn else MISSING
            wrong = ((1 - true) * y).sum() / max((1 - true).sum(), 1) if turn else WRONG
            yes, no = p * np.where(y > 0, 1 - missing, missing), (1 - p) * np.where(y > 0, wrong, 1 - wrong)
            true = yes / np.maximum(yes + no, 1e-12)
        self._fit(own, true, held, pooled)

    def _fit(self, own: list[np.ndarray], y: np.ndarray, held: np.ndarray, pooled: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Fits and calibrates the links on y (labels or their probabilities); gives the links' probabilities and the pooled weights."""
        fit, kept = ~held, SHARE_STEPS + 2
        everything = np.concatenate([o[fit, :kept] for o in own])
        pooled = _logistic(everything, np.concatenate([y[fit, k] for k in range(self.subjects)]), ridge=RIDGE, start=pooled)
        self.weights, self.scale = [], []
        out = np.zeros(y.shape)
        for j, k in enumerate(self.order):
            z = np.hstack([own[k], y[:, self.order[:j]] * self.linked])
            w = _logistic(z[fit], y[fit, k], own[k][fit, :kept] @ pooled[:-1] + pooled[-1], LINK_RIDGE, LINK_RIDGE)
            w[:kept] += pooled[:-1]
            w[-1] += pooled[-1]
            self.weights.append(w)
            s = z @ w[:-1] + w[-1]
            c = np.array([1.0, 0.0])
            if held.any():
                c = _logistic(s[held, None], y[held, k], ridge=0.1)
                c = c if c[0] > 0.2 and abs(c[1]) < 2 * c[0] else np.array([1.0, 0.0])
            self.scale.append(c)
            out[:, k] = 1 / (1 + np.exp(-np.clip(c[0] * s + c[1], -30, 30)))
        return out, pooled

    def decode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """(document x subject) 0/1: the combination of the highest joint probability, by beam search."""
        n = len(x)
        score, path = np.zeros((n, 1)), np.zeros((n, 1, 0))
        for j, k in enumerate(self.order):
            w, (a, b) = self.weights[j], self.scale[j]
            own = _own(x, k, self.subjects)
            base = own @ w[: own.shape[1]] + w[-1]
            logit = a * (base[:, None] + path @ w[own.shape[1] : -1] * self.linked) + b
            yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
            both = np.concatenate([score + yes, score + no], axis=1)
            width = path.shape[1]
            keep = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            score = np.take_along_axis(both, keep, axis=1)
            parent = keep % width
            path = np.concatenate([np.take_along_axis(path, parent[:, :, None], axis=1), (keep < width)[:, :, None].astype(float)], axis=2)
        out = np.zeros((n, self.subjects), dtype=bool)
        out[:, self.order] = path[:, 0] > 0
        return out


def sample(documents: DataFrame, labels: DataFrame, names: list[str], most: int = FIT_DOCUMENTS, most_bytes: int = FIT_BYTES) -> DataFrame:
    """(doc_id, text, source, page, labels) of at most `most` labelled documents with at most `most_bytes` of text together.

    Labels count without case and surrounding space; those that name no subject, and
    repeated ones, do not count. Documents come in order of a hash of doc_id; one that
    would exceed the bytes is left out. Of a repeated document the least copy counts.
    """
    named = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    chosen = named.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    page = F.coalesce("page_id", "doc_id") if "page_id" in documents.columns else F.col("doc_id")
    one = documents.select("doc_id", "text", "source", page.alias("page")).where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "source", "page", "labels")).alias("r")).select("doc_id", "r.*")
    # At most `most` narrow rows pass through the window.
    before = F.sum(F.octet_length("text").cast("long")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return one.withColumn("bytes", before).where(F.col("bytes") <= most_bytes).drop("bytes")


def fit(documents: DataFrame, labels: DataFrame, names: list[str], most: int = FIT_DOCUMENTS, most_bytes: int = FIT_BYTES) -> tuple[Lexicon | None, Chain | None, list[str]]:
    """The lexicon, the chain and the sources known, from the sample(), which reaches the driver; none without labelled documents."""
    rows = sorted(sample(documents, labels, names, most, most_bytes).collect(), key=lambda r: r["doc_id"])
    y = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        for s in r["labels"]:
            y[k, names.index(s)] = 1
    texts, of, pages = [r["text"] for r in rows], [r["source"] for r in rows], [r["page"] for r in rows]
    sources = sorted(s for s, n in Counter(of).items() if s is not None and n >= SOURCE_DOCUMENTS)
    if not rows:
        return None, None, sources
    lexicon = learn_lexicon(texts, y, pages)
    x, total = features(lexicon, texts, of, sources)
    some = total > 0
    held = np.array([zlib.crc32(str(p).encode()) % PARTS == PARTS - 1 for p in pages])[some]
    if not some.any():
        return None, None, sources
    return lexicon, Chain(x[some], y[some], held if (~held).any() else np.zeros(len(held), dtype=bool)), sources


_FOUND = "doc_id long, subject string"


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, subject) for every subject that a document deals with, names from `subjects`.

    Documents without a sentence on any subject (empty, redirects, junk) have no row.
    Without subjects or labels there are no rows. Documents without doc_id are left out;
    a repeated document gives its rows once for each copy of its doc_id with other subjects.
    """
    names = sorted({r["subject"].strip().lower() for r in subjects.select("subject").collect() if r["subject"]})
    spark = documents.sparkSession
    if not names:
        return spark.createDataFrame([], _FOUND)
    lexicon, chain, sources = fit(documents, labels, names, most)
    if lexicon is None:
        return spark.createDataFrame([], _FOUND)
    sent = spark.sparkContext.broadcast((lexicon, chain, sources, names))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, ch, src, nam = sent.value
        label = np.array(nam, dtype=object)
        for big in batches:
            for at in range(0, len(big), 2000):
                b = big.iloc[at : at + 2000]
                x, total = features(lex, b["text"].tolist(), b["source"].tolist(), src)
                some = np.flatnonzero(total > 0)
                if not len(some):
                    continue
                d, s = np.nonzero(ch.decode(x[some]))
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[some[d]], "subject": label[s]})

    return documents.select("doc_id", "text", "source").where("doc_id is not null").mapInPandas(classify, _FOUND)

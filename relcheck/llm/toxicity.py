"""Toxicity by a classifier chain of logistic models.

Categories are predicted one after another; each later model also sees the log odds of the earlier
categories' probabilities, which in training come from models that had not seen the row (out of fold).
Features are words and beginnings of words that tell some category apart, each as found once, twice or
three times at least: inflected or compounded insults share their beginning only, and clean texts may
have one such word by chance. The first category also sees the texts' style, which reaches the others
through its probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .features import STYLE, labelled_sample, style
from .lang_id import held_out
from .textscan import ALNUM, LOWER, map_batches, mix, slices, span_hashes, staged, text_bytes, word_hashes, words, _BYTE_CODE

CATEGORIES = ("poor", "toxic")
#: Bytes of the beginnings of longer words that count as grams besides the whole words.
STEMS = (4, 5, 6, 7, 8)
#: A gram is a feature of its own as found so many times at least.
TIMES = (1, 2, 3)
_STEM = np.uint64(0x5DEECE66D)


def heads_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 16-bit code of the first four bytes of each word: words that share a gram share it."""
    code = np.zeros(len(starts), np.uint32)
    for i in range(STEMS[0]):
        code = code << np.uint32(8) | np.where(starts + i < ends, data[np.minimum(starts + i, len(data) - 1)], 0).astype(np.uint32)
    return (code * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)


def grams_of(data: np.ndarray, off: np.ndarray, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, head) of every word and of every beginning of one; with heads, of words whose head is true in it."""
    data = LOWER[data]
    starts, ends, at = words(data, off, ALNUM)
    text, head = np.repeat(np.arange(len(off) - 1), np.diff(at)), heads_of(data, starts, ends)
    if heads is not None:
        wanted = np.flatnonzero(heads[head])
        starts, ends, text, head = starts[wanted], ends[wanted], text[wanted], head[wanted]
    size = ends - starts
    which = [np.arange(len(starts)), *(np.flatnonzero(size > n) for n in STEMS)]
    all_of = np.concatenate(which)
    end = np.concatenate([ends, *(starts[x] + n for x, n in zip(which[1:], STEMS))])
    h = span_hashes(_BYTE_CODE[data], starts[all_of], end)
    h[len(starts) :] ^= _STEM
    return text[all_of], h, head[all_of]


def marks_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, times, head) of each gram of a text with times 1, and again with 2 and 3 where it occurs as often."""
    text, h, head = grams_of(data, off)
    order = np.lexsort((h, text))
    text, h, head = text[order], h[order], head[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h)))
    often = [first[count >= k] for k in TIMES]
    at = np.concatenate(often)
    return text[at], h[at], np.repeat(TIMES, [len(x) for x in often]), head[at]


class Vocabulary:
    """Marks that are looked for: grams, and how often a text must have them at least."""

    def __init__(self, grams: np.ndarray, least: np.ndarray, heads: np.ndarray):
        self.least = least
        self.bases, self.base = np.unique(grams, return_inverse=True)
        self.heads = np.zeros(1 << 16, bool)
        self.heads[heads] = True

    def __len__(self) -> int:
        return len(self.least)

    def presence(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts (rows) have which marks (columns)."""
        n = len(off) - 1
        if not len(self.least):
            return np.zeros((n, 0), np.float32)
        text, h, _ = grams_of(data, off, self.heads)
        at = np.minimum(np.searchsorted(self.bases, h), len(self.bases) - 1)
        here = self.bases[at] == h
        count = np.bincount(text[here] * len(self.bases) + at[here], minlength=n * len(self.bases)).reshape(n, -1)
        return (count[:, self.base] >= self.least).astype(np.float32)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.2, steps: int = 25) -> np.ndarray:
    """Weights (the last one is the bias) by Newton's method with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (y - q) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Chain:
    """Logistic models in a row, each fed with the features and the earlier categories' log odds."""

    def __init__(self, vocabulary: Vocabulary, folds: int = 5, own: np.ndarray | None = None):
        """own: which of the marks (columns) each category (row) looks at, all by default."""
        self.vocabulary, self.folds, self.weights, self.own = vocabulary, folds, [], own
        self.mean, self.scale = np.zeros(len(STYLE)), np.ones(len(STYLE))

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.hstack([self.vocabulary.presence(data, off), (style(data, off) - self.mean) / self.scale])

    def _odds(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.clip(x @ w[:-1] + w[-1], -8, 8)[:, None]

    def _input(self, c: int, x: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
        n = len(self.vocabulary)
        plain = x[:, :n] if self.own is None else x[:, :n] * self.own[c]
        return np.hstack([plain, *earlier]) if c else np.hstack([plain, x[:, n:]])

    def fit(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> "Chain":
        style_part = x[:, len(self.vocabulary) :]
        if len(x):
            self.mean, self.scale = style_part.mean(axis=0), style_part.std(axis=0) + 1e-9
        whole = np.hstack([x[:, : len(self.vocabulary)], (style_part - self.mean) / self.scale])
        earlier: list[np.ndarray] = []
        for c in range(y.shape[1]):
            x = self._input(c, whole, earlier)
            odds = np.zeros((len(x), 1))
            for k in range(self.folds):
                out = fold == k
                if out.any() and not out.all():
                    odds[out] = self._odds(x[out], fit_logistic(x[~out], y[~out, c]))
            self.weights.append(fit_logistic(x, y[:, c]))
            earlier.append(odds)
        return self

    def predict(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x = self.features(data, off)
        earlier: list[np.ndarray] = []
        for c, w in enumerate(self.weights):
            earlier.append(self._odds(self._input(c, x, earlier), w))
        return 1 / (1 + np.exp(-np.hstack(earlier)))


def _families(docs: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Rows (doc_id, text, *categories) of which one a family of copies stays: least hash of five words, and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = text_bytes(batch.column("text"))
            data = LOWER[data]
            starts, ends, at = words(data, off, ALNUM)
            h = word_hashes(data, starts, ends)
            family = []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                s = np.arange(a, max(a + 1, b - 4)) if b > a else np.zeros(0, np.int64)
                family.append(int(span_hashes(h[a:b], s - a, np.minimum(s + 5, b) - a).min()) if b > a else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(family, np.uint64).view(np.int64)), *(batch.column(c) for c in categories)], ["doc_id", "family", *categories])

    found = map_batches(docs, run, "doc_id long, family long, " + ", ".join(f"`{c}` int" for c in categories))
    kept = found.groupBy("family", *categories).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(F.broadcast(kept), "doc_id", "left_semi")  # as many ids as the sample has at most


def learn(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, most: int = 8_000, vocabulary: int = 256, least: int = 5, chi_squared: float = 40.0, folds: int = 5) -> Chain:
    """Fits the chain to a bounded sample of `most` labelled documents that are not held out.

    Of a family of copies one document counts, so that a family's words don't pass for telling ones.
    A category looks at the `vocabulary` marks with the largest chi-squared statistic for it, of at least
    `chi_squared`, that `least` documents have; of marks that the same documents have, at one. Without
    labels every probability is one half.
    """
    sample = staged(_families(staged(labelled_sample(docs, labels, list(categories), most)), categories))
    totals = sample.agg(F.count("*"), *(F.sum(c) for c in categories)).first()
    n, positive = totals[0], [float(x or 0) for x in totals[1:]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, gram, times, head = marks_of(*text_bytes(batch.column("text")))
            sign = mix(batch.column("doc_id").to_numpy().astype(np.int64).view(np.uint64))
            values = [batch.column(c).to_numpy() for c in categories]
            for k in TIMES:
                t, (unique, place, which) = text[times == k], np.unique(gram[times == k], return_index=True, return_inverse=True)
                who = np.zeros(len(unique), np.uint64)
                np.bitwise_xor.at(who, which, sign[t])
                sums = [np.bincount(which, v[t], len(unique)).astype(np.int64) for v in values]
                yield pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(np.full(len(unique), k, np.int32)), pa.array(head[times == k][place]), pa.array(np.bincount(which, minlength=len(unique))), pa.array(who.view(np.int64)), *map(pa.array, sums)], ["gram", "times", "head", "n", "who", *categories])

    counts = map_batches(sample, count, "gram long, times int, head long, n long, who long, " + ", ".join(f"`{c}` long" for c in categories))
    by_mark = counts.groupBy("gram", "times").agg(F.min("head").alias("head"), F.sum("n").alias("n"), F.bit_xor("who").alias("who"), *(F.sum(c).alias(c) for c in categories)).where(F.col("n") >= least)
    found = staged(by_mark.groupBy("who", "n", *categories).agg(F.min(F.struct("gram", "times", "head")).alias("mark")).select("n", *categories, "mark.*"))
    top: list[set] = []
    for c, pos in zip(categories, positive):
        gap = F.col(c) * float(n) - F.col("n") * pos
        chi = gap * gap * float(n) / (F.greatest(F.lit(1.0), F.col("n") * F.lit(float(n)) - F.col("n") * F.col("n")) * max(1.0, pos * (n - pos)))
        telling = found.withColumn("chi", chi).where(F.col("chi") >= chi_squared)
        top.append({tuple(r) for r in telling.orderBy(F.desc("chi"), "gram", "times").limit(vocabulary).select("gram", "times", "head").collect()})
    marks = sorted(set().union(*top))
    own = np.array([[m in t for m in marks] for t in top], np.float32).reshape(len(categories), -1)
    gram, times, head = np.array(marks, np.int64).reshape(-1, 3).T
    chain = Chain(Vocabulary(gram.copy().view(np.uint64), times, head), folds, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = chain.features(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32())), *(batch.column(c) for c in categories)], ["doc_id", "x", *categories])

    rows = map_batches(sample, run, "doc_id long, x array<float>, " + ", ".join(f"`{c}` int" for c in categories)).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    x = np.stack(rows["x"].to_list()) if len(rows) else np.zeros((0, len(chain.vocabulary) + len(STYLE)))
    fold = (rows["doc_id"].to_numpy(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % folds
    return chain.fit(x, rows[list(categories)].to_numpy(float), fold)


def score(docs: DataFrame, chain: Chain, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """doc_id, held_out, p_<category> for each, score (the last category's) and predicted, for every row.

    Whole texts alone decide; null texts are empty; repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = shared.value.predict(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, j]) for j in range(len(names)))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in names))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, F.col(names[-1]).alias("score"), (F.col(names[-1]) >= 0.5).cast("int").alias("predicted"))

"""A generalised additive model with pairwise interactions that scores text quality.

Cyclic boosting: each round visits every feature, fits one shallow tree to the gradient over the
feature's bins, and adds it to that feature's lookup table. Pairs whose two-way bins explain most of
what is left then get tables of their own in the same way. Scoring is one lookup and addition a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .features import STYLE, labelled_sample, style
from .lang_id import held_out
from .textscan import map_batches, slices, text_bytes


def _split(grad: np.ndarray, hess: np.ndarray, depth: int, l2: float, least: float) -> np.ndarray:
    """Leaf values over ordered bins of the best tree of this depth, split where the gain is largest."""
    g, h = np.cumsum(grad), np.cumsum(hess)
    gain = np.where((h[:-1] >= least) & (h[-1] - h[:-1] >= least), g[:-1] ** 2 / (h[:-1] + l2) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + l2), -1.0) if depth and len(g) > 1 else np.zeros(0)
    if not len(gain) or gain.max() <= g[-1] ** 2 / (h[-1] + l2) + 1e-9:
        return np.full(len(grad), g[-1] / (h[-1] + l2))
    k = int(gain.argmax()) + 1
    return np.concatenate([_split(grad[:k], hess[:k], depth - 1, l2, least), _split(grad[k:], hess[k:], depth - 1, l2, least)])


class AdditiveModel:
    """Lookup tables of single features and of pairs; scores are the logistic of their sum."""

    def __init__(self, bins: int = 32, pair_bins: int = 8, pairs: int = 6, rounds: int = 120, rate: float = 0.1, depth: int = 2, l2: float = 1.0, least: float = 1.0):
        self.bins, self.pair_bins, self.n_pairs, self.rounds, self.rate = bins, pair_bins, pairs, rounds, rate
        self.tree = (depth, l2, least)
        self.bias, self.cuts, self.tables, self.pairs = 0.0, [], [], []

    def _bin(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "AdditiveModel":
        rate = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(rate / (1 - rate)))
        if not len(y) or y.min() == y.max():
            return self
        edges = lambda k: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, k + 1)[1:-1])) for j in range(x.shape[1])]
        self.cuts, self.pair_cuts = edges(self.bins), edges(self.pair_bins)
        b, p = self._bin(x, self.cuts), self._bin(x, self.pair_cuts)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        f = np.full(len(y), self.bias)

        def boost(which: np.ndarray, table: np.ndarray, grow) -> None:
            nonlocal f
            q = 1 / (1 + np.exp(-f))
            grad, hess = np.bincount(which, y - q, table.size), np.bincount(which, q * (1 - q), table.size)
            step = self.rate * grow(grad, hess)
            table += step.reshape(table.shape)
            f = f + step[which]

        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                boost(b[:, j], table, lambda g, h: _split(g, h, *self.tree))
        size = [len(c) + 1 for c in self.pair_cuts]
        q = 1 / (1 + np.exp(-f))
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            which = p[:, i] * size[j] + p[:, j]
            g, h = np.bincount(which, y - q, size[i] * size[j]), np.bincount(which, q * (1 - q), size[i] * size[j])
            gains.append((float((g**2 / (h + self.tree[1])).sum()), i, j))
        for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]:
            self.pairs.append((i, j, np.zeros((size[i], size[j]))))

        def grid(rows: int, columns: int):
            def grow(g: np.ndarray, h: np.ndarray) -> np.ndarray:
                g, h = g.reshape(rows, columns), h.reshape(rows, columns)
                best, most = np.zeros((rows, columns)), -1.0
                for axis in (0, 1):  # one cut along one feature, then one along the other on each side
                    upto = np.cumsum(g.sum(axis=1 - axis)), np.cumsum(h.sum(axis=1 - axis))
                    gain = upto[0][:-1] ** 2 / (upto[1][:-1] + self.tree[1]) + (upto[0][-1] - upto[0][:-1]) ** 2 / (upto[1][-1] - upto[1][:-1] + self.tree[1])
                    if not len(gain) or gain.max() <= most:
                        continue
                    most, k = gain.max(), int(gain.argmax()) + 1
                    best = np.zeros((rows, columns))
                    for part in (slice(0, k), slice(k, None)):
                        at = (part, slice(None)) if axis == 0 else (slice(None), part)
                        leaf = _split(g[at].sum(axis=axis), h[at].sum(axis=axis), 1, self.tree[1], self.tree[2])
                        best[at] = leaf[None, :] if axis == 0 else leaf[:, None]
                return best.ravel()

            return grow

        for _ in range(self.rounds // 2):
            for i, j, table in self.pairs:
                boost(p[:, i] * size[j] + p[:, j], table, grid(size[i], size[j]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        if self.tables:
            b, p = self._bin(x, self.cuts), self._bin(x, self.pair_cuts)
            for j, table in enumerate(self.tables):
                f += table[b[:, j]]
            for i, j, table in self.pairs:
                f += table[p[:, i], p[:, j]]
        return 1 / (1 + np.exp(-f))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> AdditiveModel:
    """Fits the model to a bounded sample of `most` labelled documents that are not held out.

    Without labels, or with labels of one kind only, the model is their smoothed rate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = style(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, j]) for j in range(len(STYLE))), batch.column(label)], [*STYLE, label])

    sample = map_batches(labelled_sample(docs, labels, [label], most), run, ", ".join(f"{c} double" for c in STYLE) + f", {label} int").toPandas()
    sample = sample.sort_values([*STYLE, label], ignore_index=True)  # the same sums whatever the tasks' order
    return AdditiveModel().fit(sample[list(STYLE)].to_numpy(), sample[label].to_numpy(float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from the whole text alone; null is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            p = shared.value.predict(style(*text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, predicted int")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

"""Exact top-k search by BM25 over an inverted index in shards, with block-max pruning.

Each shard of documents has an inverted index: postings of a term in document order, cut into
blocks of BLOCK documents whose largest impact is kept. For a query, rarer terms are summed first;
the k-th best of the most promising documents is the threshold, and only documents whose sum so far
plus the block maxima of the other terms reaches it are scored in full, the most promising first. Document counts, lengths
and term frequencies are those of the whole corpus, so the shards' lists merge exactly.
Queries are taken in blocks of a stated size, each a broadcast against all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .packing import expand
from .textscan import ALNUM, LOWER, map_batches, slices, staged, text_bytes, word_hashes, words

K1, B = 1.2, 0.75
BLOCK = 8


def text_words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash) of every word of a batch, and each text's number of words."""
    data, off = text_bytes(batch.column("text"))
    data = LOWER[data]
    starts, ends, at = words(data, off, ALNUM)
    return np.repeat(np.arange(len(off) - 1), np.diff(at)), word_hashes(data, starts, ends), np.diff(at)


class Index:
    """Inverted index of one shard over the terms of a query block, and the shard's forward lists.

    Documents are put in an order that keeps alike ones together (by which of the commonest terms they
    have, then by length), so that a block's maxima are close to what its documents score.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray, mean_length: float, n_terms: int):
        self.n = len(length)
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean_length, 1e-9)))
        self.df = np.bincount(term, minlength=n_terms)
        signature = np.zeros(self.n, np.int64)
        for bit, t in enumerate(np.argsort(-self.df, kind="stable")[:24].tolist()):
            signature[doc[term == t]] |= 1 << (24 - bit)
        self.order = np.lexsort((length, signature))  # place to given number of a document
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        # doc-major, terms ascending: the order of summation is the same in every shard
        doc = place[doc]
        by_doc = np.lexsort((term, doc))
        doc, term, impact = doc[by_doc], term[by_doc], impact[by_doc]
        self.doc_at = np.searchsorted(doc, np.arange(self.n + 1))
        self.doc_term, self.doc_impact = term, impact
        by_term = np.argsort(term, kind="stable")
        self.post_doc, self.post_impact = doc[by_term], impact[by_term]
        self.term_at = np.concatenate([[0], np.cumsum(self.df)])
        # terms that are common here have block maxima and rows by document; rarer ones are always summed
        self.n_blocks = -(-self.n // BLOCK)
        self.common = np.flatnonzero(self.df > max(self.n // 10, 8))
        self.row = np.full(n_terms, -1)
        self.row[self.common] = np.arange(len(self.common))
        self.block_max = np.zeros((len(self.common), self.n_blocks), np.float32)
        of = self.row[term]
        here = of >= 0
        np.maximum.at(self.block_max, (of[here], doc[here] // BLOCK), (impact[here] * (1 + 1e-6)).astype(np.float32))
        self.dense = np.zeros((self.n, len(self.common)), np.float32)
        self.dense[doc[here], of[here]] = impact[here]
        self.own = np.zeros(n_terms)  # weights of the query at hand, zero in between

    def bounds(self, queries: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
        """For each query and block, the most that the common terms can add: weights times block maxima."""
        w = np.zeros((len(queries), len(self.common)), np.float32)
        for i, terms in enumerate(queries):
            row = self.row[terms]
            w[i, row[row >= 0]] = weight[terms[row >= 0]]
        return (w @ self.block_max) * np.float32(1 + 1e-5)

    def full(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores of these documents."""
        counts = self.doc_at[docs + 1] - self.doc_at[docs]
        at = expand(self.doc_at[docs], counts)
        return np.bincount(np.repeat(np.arange(len(docs)), counts), self.doc_impact[at] * self.own[self.doc_term[at]], len(docs))

    def top(self, terms: np.ndarray, weight: np.ndarray, k: int, key: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for a query with these terms (weight by term), ties by key; all score above 0.

        The sums of the rare terms and the block maxima of the others bound every document. The most
        promising ones set the threshold; of the rest only those whose bound reaches it are summed, in
        single precision, and what then reaches it within rounding is scored in full.
        """
        slack = 1 - 1e-4
        row = self.row[terms]
        rare, common = terms[(row < 0) & (self.df[terms] > 0)], row[row >= 0]
        at = expand(self.term_at[rare], self.df[rare])
        partial = np.bincount(self.post_doc[at], self.post_impact[at] * np.repeat(weight[rare], self.df[rare]), self.n)
        bound = partial + np.repeat(rest, BLOCK)[: self.n]
        w = np.zeros(len(self.common), np.float32)
        w[common] = weight[self.common[common]]
        docs = np.flatnonzero(bound > 0)
        if len(docs) > 8 * k:
            tried = docs[np.argpartition(-bound[docs], 8 * k)[: 8 * k]]
            seen = partial[tried] + self.dense[tried] @ w
            docs = docs[bound[docs] >= np.partition(seen, len(seen) - k)[len(seen) - k] * slack]
        score = partial[docs] + self.dense[docs] @ w
        if len(docs) > k:
            docs = docs[score >= np.partition(score, len(score) - k)[len(score) - k] * slack]
        self.own[terms] = weight[terms]
        score = self.full(docs)
        self.own[terms] = 0
        docs = self.order[docs]
        best = np.lexsort((key[docs], -score))[:k]
        best = best[score[best] > 0]
        return docs[best], score[best]


class QueryBlock:
    """The distinct terms of a block of queries."""

    def __init__(self, ids: list, terms: list[np.ndarray]):
        self.ids = ids
        counts = [len(t) for t in terms]
        self.terms, number = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.number = number
        self.weight: np.ndarray | None = None
        self.mean_length = 0.0
        self.shift = np.uint64(64 - max(1, min(24, len(self.terms).bit_length())))
        heads = self.terms >> self.shift
        self.first = np.searchsorted(heads, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For word hashes: their number in this block, and whether they have one."""
        number, here = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):  # hashes with equal leading bits are few
            hit = self.terms[at[open_]] == h[open_]
            number[open_[hit]], here[open_[hit]] = at[open_[hit]], True
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return number, here

    def counts(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, term number, occurrences) of a batch, and each text's number of words."""
        text, h, length = text_words(batch)
        number, here = self.known(h)
        key = np.sort(text[here] * len(self.terms) + number[here])
        where = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        text, number = np.divmod(key[where], max(len(self.terms), 1))
        return text, number, np.diff(np.append(where, len(key))), length


def query_blocks(queries: DataFrame, most_queries: int, most_terms: int) -> Iterator[QueryBlock]:
    """Queries as blocks of at most so many, with at most so many terms in all (one query at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text, h, length = text_words(batch)
            at = np.concatenate([[0], np.cumsum(length)])
            terms = [np.unique(h[a:b]) for a, b in zip(at, at[1:])]
            at = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(terms).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").cast(pa.int64()), lists], ["query_id", "terms"])

    ids, terms, size = [], [], 0
    for r in staged(map_batches(queries.select("query_id", "text"), run, "query_id long, terms array<long>")).toLocalIterator():
        t = np.array(r[1], np.int64).view(np.uint64)
        if ids and (len(ids) >= most_queries or size + len(t) > most_terms):
            yield QueryBlock(ids, terms)
            ids, terms, size = [], [], 0
        ids.append(r[0])
        terms.append(t)
        size += len(t)
    if ids:
        yield QueryBlock(ids, terms)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, most_queries: int = 20_000, most_terms: int = 8_000_000, shard_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query the k documents with the highest BM25 score.

    A query is the set of its distinct words; all documents are searched, by whole texts. Equal scores
    rank by the least doc_id, null first. Only documents that share a word are found, so null and empty
    queries have no rows; repeated rows rank as often as they occur. Shards are at most `shard_bytes` of
    text in a task, or one text. No documents or no queries give an empty result.
    """
    spark = docs.sparkSession
    spark_context = spark.sparkContext
    narrow = docs.select("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch], block: QueryBlock) -> Iterator[tuple[np.ndarray, ...]]:
        """Keys and validity, then doc, term, tf and lengths of one shard after another."""
        held, size = [], 0
        for batch in slices(batches, "text"):
            keys = batch.column("doc_id").cast(pa.int64())
            held.append((keys, *block.counts(batch)))
            size += batch.column("text").nbytes
            if size >= shard_bytes:
                yield joined(held)
                held, size = [], 0
        if held:
            yield joined(held)

    def joined(held: list) -> tuple:
        base = np.cumsum([0, *(len(x[4]) for x in held)])
        doc = np.concatenate([x[1] + b for x, b in zip(held, base)])
        term, tf, length = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
        return pa.chunked_array([x[0] for x in held]).combine_chunks(), doc, term, tf.astype(float), length

    def statistics(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, total, n = shared.value, 0, 0
            df = np.zeros(len(block.terms), np.int64)
            for batch in slices(batches, "text"):
                _, number, _, length = block.counts(batch)
                df += np.bincount(number, minlength=len(df))
                total, n = total + int(length.sum()), n + len(length)
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], used])), pa.array(np.concatenate([[n, total], df[used]]))], ["term", "n"])

        return run

    def score(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for keys, doc, term, tf, length in shards(batches, block):
                index = Index(doc, term, tf, length, block.mean_length, len(block.terms))
                order = keys.fill_null(np.iinfo(np.int64).min).to_numpy()
                found, scores, which = [], [], []
                for begin in range(0, len(block.ids), 256):
                    some = range(begin, min(begin + 256, len(block.ids)))
                    terms = [block.number[block.at[q] : block.at[q + 1]] for q in some]
                    rest = index.bounds(terms, block.weight)
                    for i, q in enumerate(some):
                        best, s = index.top(terms[i], block.weight, min(k, index.n), order, rest[i])
                        found.append(best)
                        scores.append(s)
                        which.append(np.full(len(best), q))
                which = np.concatenate(which)
                ids = pa.array(block.ids, pa.int64()).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([ids, keys.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], ["query_id", "doc_id", "score"])

        return run

    lists = None
    for block in query_blocks(queries, most_queries, most_terms):
        facts = map_batches(narrow, statistics(spark_context.broadcast(block)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        facts = facts.set_index("term")["n"]  # bounded by the block's terms
        n = float(facts.get(-2, 0))
        df = facts.reindex(np.arange(len(block.terms)), fill_value=0).to_numpy(float)
        block.mean_length = float(facts.get(-1, 0)) / max(n, 1.0)
        block.weight = np.log1p((n - df + 0.5) / (df + 0.5))
        part = map_batches(narrow, score(spark_context.broadcast(block)), "query_id long, doc_id long, score double")
        lists = part if lists is None else lists.union(part)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")

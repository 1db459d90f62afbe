"""Ranked search with integer scores by pipelined term partitioning.

The index of a shard of documents has a posting list for each of its terms. Terms are dealt to owners
by how common they are, rarest first. Queries travel in bundles: for each shard a bundle visits the owners
one after another, in a cogroup of its accumulators with the owner's lists, and each owner adds what its
terms contribute. A bundle carries its non-zero accumulators only, so what moves is small until the last
owner, whose terms nearly all documents have; that one selects the best of the shard and sends nothing else on.

Contributions are whole numbers of 64 bits, so sums don't depend on the order of owners. Every term
of a document is indexed; words are compared as words, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .textscan import ALNUM, LOWER, fits, map_batches, slices, staged, text_bytes, words

#: A shard ends with the text that brings it to this many bytes, or with so many documents.
SHARD_BYTES, SHARD_DOCS = 8 << 20, 4096
#: Items of a bundle: with SHARD_DOCS, a million accumulators (8 MB) at most while an owner adds.
BUNDLE = 256
#: Query terms that a broadcast may hold; the index is met by a shuffle beyond.
MOST_TERMS = 500_000
#: An owner has terms of up to this share of the documents; the last one has the rest.
SHARES = (1 / 256, 1 / 16)

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_INDEX = "shard long, term string, doc array<int>, tf array<int>, ids array<long>"
_STATE = "shard long, bundle int, cell array<int>, score array<long>"
_FOUND = "bundle int, slot int, doc_id long, score long"


def terms_of(text: Column) -> Column:
    """The terms of a text, repeats included; none for null."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(TERM), F.lit(0))


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def _shard(number: int, ids: pa.Array, pieces: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of one shard: a posting list for each term, and one row without term, whose doc counts terms and whose ids are the documents.

    Documents are numbered by ascending id, null first, so that a lower number wins a tie. pieces: of each slice its
    words one after another, and each word's end with where the texts' words begin.
    """
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    data = np.concatenate([p[0] for p in pieces])
    sizes = np.concatenate([p[1] for p in pieces])
    counts = np.concatenate([p[2] for p in pieces])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    spelled = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    n_terms, n_docs = len(spelled.dictionary), len(ids)
    key = np.sort(spelled.indices.to_numpy().astype(np.int64) * n_docs + np.repeat(place, counts))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    term, doc = np.divmod(key[first], max(n_docs, 1))
    at = np.searchsorted(term, np.arange(n_terms + 1))
    # the row without term stands first
    doc, tf, at = np.concatenate([counts[order], doc]), np.concatenate([np.zeros(n_docs, np.int64), tf]), np.concatenate([[0], at + n_docs])
    none = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(n_terms + 1, n_docs)]).astype(np.int32)), ids.take(pa.array(order)).cast(pa.int64()))
    names = pa.concat_arrays([pa.nulls(1, pa.string()), spelled.dictionary.cast(pa.string())])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n_terms + 1, number)), names, _lists(doc, at, pa.int32()), _lists(tf, at, pa.int32()), none], ["shard", "term", "doc", "tf", "ids"])


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The shards' inverted lists: (shard, term, doc, tf), and for each shard a row without term: doc has the documents' lengths, ids their doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, pieces, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in slices(batches, "text", shard_bytes):
            for begin in range(0, batch.num_rows, shard_docs):
                part = batch.slice(begin, shard_docs)
                data, off = text_bytes(part.column("text"))
                data = LOWER[data]
                starts, ends, at = words(data, off, ALNUM)
                # a word's bytes are all term bytes, so dropping the others leaves the words side by side
                if ids and (size + len(data) > shard_bytes or sum(map(len, ids)) + part.num_rows > shard_docs):
                    yield _shard(number, pa.concat_arrays(ids), pieces)
                    number, ids, pieces, size = number + 1, [], [], 0
                ids.append(part.column("doc_id").cast(pa.int64()))
                pieces.append((data[ALNUM[data]], ends - starts, np.diff(at)))
                size += len(data)
        if ids:
            yield _shard(number, pa.concat_arrays(ids), pieces)

    return map_batches(docs.select("doc_id", "text"), run, _INDEX)


def owner_step(last: bool, k: int):
    """One owner: adds its terms' contributions to the accumulators of a bundle in one shard; the last one selects the k best of each item.

    lists has a row without weight (m of each document in tf, ids with the last owner) and the owner's posting lists
    with weight and slots (places of the items in the bundle that have the term).
    """

    def run(key: tuple, state: pa.Table, lists: pa.Table) -> pa.Table:
        weights = lists.column("weight").to_pylist()
        own = [i for i, w in enumerate(weights) if w is not None]
        # equal, for a bundle that came without state: a shard has one row without weight
        head = weights.index(None)
        flat = {c: lists.column(c).combine_chunks() for c in ("doc", "tf", "slots")}
        at = {c: x.offsets.to_numpy() for c, x in flat.items()}
        value = {c: x.values.to_numpy() for c, x in flat.items()}
        pick = lambda c, i: value[c][at[c][i] : at[c][i + 1]]
        m = pick("tf", head).astype(np.int64)
        had = state.column("cell").combine_chunks().values.to_numpy(), state.column("score").combine_chunks().values.to_numpy()
        n_slots = 1 + max([int(had[0].max()) // len(m) if len(had[0]) else -1, *(int(pick("slots", i).max()) for i in own)])
        score = np.zeros(n_slots * len(m), np.int64)
        score[had[0]] = had[1]
        score = score.reshape(n_slots, len(m))
        for i in own:
            doc, tf = pick("doc", i), pick("tf", i).astype(np.int64)
            add = weights[i] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            for slot in pick("slots", i).tolist():
                score[slot, doc] += add  # a list has a document once
        if not last:
            cell = np.flatnonzero(score)
            rows = [pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), _lists(cell, np.array([0, len(cell)]), pa.int32()), _lists(score.ravel()[cell], np.array([0, len(cell)]), pa.int64())]
            return pa.Table.from_arrays(rows, ["shard", "bundle", "cell", "score"])
        slots, docs = [], []
        for slot, own_score in enumerate(score):
            doc = np.flatnonzero(own_score)
            if len(doc) > k:
                least = np.partition(own_score[doc], len(doc) - k)[len(doc) - k]
                doc = doc[own_score[doc] >= least]
            doc = doc[np.lexsort((doc, -own_score[doc]))[:k]]  # lower numbers are lower ids
            slots.append(np.full(len(doc), slot))
            docs.append(doc)
        slot, doc = np.concatenate([np.zeros(0, np.int64), *slots]), np.concatenate([np.zeros(0, np.int64), *docs])
        ids = lists.column("ids").combine_chunks()[head].values.take(pa.array(doc))
        found = [pa.array(np.full(len(doc), key[1].as_py()), pa.int32()), pa.array(slot, pa.int32()), ids, pa.array(score[slot, doc] if len(doc) else doc)]
        return pa.Table.from_arrays(found, ["bundle", "slot", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS, bundle_items: int = BUNDLE, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item of (item_id, text) the k documents of (doc_id, text) with the highest score above 0.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms has m = 50 + 50 n N div L; the
    score sums w * (10^9 tf div (1000 tf + 20 m)) over the item's terms, once each. N counts documents with a
    term, L all their terms. Equal scores rank by the least doc_id, null first, repeated rows as often
    as they occur. Rows that share an item_id, null too, are one item with the terms of all; items
    without a term that a document has get no rows. Null texts have no terms. Texts are indexed whole,
    in shards of at most `shard_bytes` (or one text) and `shard_docs` documents.
    """
    spark = docs.sparkSession
    wanted = staged(items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct())
    vocabulary = wanted.select("term").distinct()
    lists = index(docs, shard_bytes, shard_docs)
    # of the index only what some item asks for is written, and each shard's own row
    lists = staged(lists.join(fits(vocabulary.withColumn("asked", F.lit(True)), most_terms), "term", "left").where("asked OR term IS NULL").drop("asked"))
    shards = lists.where("term IS NULL")
    n_docs, n_terms = shards.agg(F.sum(F.size(F.filter("doc", lambda n: n > 0))), F.sum(F.aggregate("doc", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    n_items = wanted.select("item_id").distinct().count()
    if not n_terms or not n_items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    df = F.sum(F.size("doc"))
    share = F.col("df") / F.lit(n_docs)
    owner = sum(((share > s).cast("int") for s in SHARES), F.lit(0))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1)))
    owned = lists.where("term IS NOT NULL").groupBy("term").agg(df.alias("df")).select("term", weight.cast("long").alias("weight"), owner.alias("owner"))

    # items are dealt to bundles by hash; their places in a bundle are numbered within it
    n_bundles = -(-n_items // bundle_items)
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(n_bundles)).cast("int")
    places = Window.partitionBy("bundle").orderBy("item_id")
    seats = staged(wanted.select("item_id").distinct().withColumn("bundle", bundle).withColumn("slot", F.row_number().over(places) - 1))
    asked = wanted.join(seats, wanted["item_id"].eqNullSafe(seats["item_id"])).groupBy("term", "bundle").agg(F.collect_list("slot").alias("slots"))
    asked = staged(asked.join(owned, "term").where("weight > 0"))

    length = F.transform("doc", lambda n: (50 + F.call_function("div", n.cast("long") * F.lit(50 * n_docs), F.lit(n_terms))).cast("int"))
    heads = shards.select("shard", F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle"), length.alias("m"), "ids")
    empty = F.array().cast("array<int>")
    # columns of its own: both sides of a cogroup come from one table
    state = heads.select(F.col("shard").alias("shard"), F.col("bundle").alias("bundle"), empty.alias("cell"), F.array().cast("array<long>").alias("score"))
    for stage in range(len(SHARES) + 1):
        last = stage == len(SHARES)
        named = F.col("ids") if last else F.array().cast("array<long>")
        head = heads.select("shard", "bundle", F.lit(None).cast("long").alias("weight"), empty.alias("slots"), empty.alias("doc"), F.col("m").alias("tf"), named.alias("ids"))
        mine = lists.join(fits(asked.where(F.col("owner") == stage), most_terms), "term").select("shard", "bundle", "weight", "slots", "doc", "tf", "ids")
        both = state.groupBy("shard", "bundle").cogroup(head.union(mine).groupBy("shard", "bundle"))
        state = both.applyInArrow(owner_step(last, k), _FOUND if last else _STATE)
    ranks = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = state.join(fits(seats, most_terms), ["bundle", "slot"])
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

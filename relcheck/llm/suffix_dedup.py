"""Repeated passages by sparse suffix arrays.

Of all suffixes of the texts (as words) only those at minimiser positions are kept: in every window
of `length` words, the k words with the least hash. Equal windows have equal minimisers, so two copies
of a passage of `length` words or more keep suffixes that begin alike. Suffixes are brought together by
their first k words. Where the whole context that a suffix answers for (all words of the windows it is
the minimiser of) is equal, its copies match as a whole, left and right; where contexts differ, one
suffix of each context is extended word by word, by two independent 64-bit hashes of each of its windows.
Nothing is compared pair by pair. Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .packing import expand
from .textscan import ALNUM, LOWER, cut_spans, discard, map_batches, mix, scratch, set_apart, slices, span_hashes, staged, text_bytes, word_hashes, words

LENGTH = 50
K = 8
#: Word hashes are mixed with it for the second hash of a window.
SECOND = np.uint64(0xD6E8FEB86659FD93)


def anchors_of(hashes: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For each minimiser: its k-word hash, its context's hash, its text, first and last window start."""
    n, w = len(hashes), length - k + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    starts = np.arange(n - k + 1)
    grams = span_hashes(hashes, starts, starts + k)
    # least hash of w grams from each start, leftmost of equals, by doubling
    best = np.arange(len(grams))
    width = 1
    while width < w:
        step = min(width, w - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        width += step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    s = np.arange(len(best))
    ok = np.flatnonzero(text[s] == text[s + length - 1])
    s, p = ok, best[ok]
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (text[s[1:]] != text[s[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    lo, hi = s[first], s[last] if len(s) else s
    context = span_hashes(hashes, lo, hi + length)
    return grams[p[first]], context, text[lo], lo - at[text[lo]], hi - at[text[lo]]


def _scan(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    data, off = text_bytes(batch.column("text"))
    low = LOWER[data]
    starts, ends, at = words(low, off, ALNUM)
    return data, off, starts, at, word_hashes(low, starts, ends)


def repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """(row, doc_id, first word, last word + 1, removable, first_doc) for windows that occur again.

    row is a hash of doc_id and text; rows equal in both count as one. A window is removable unless
    it is the first one with its words by (doc_id, row, position), null ids first. Spans may overlap. What
    a removable window shares with its own first occurrence (a text that repeats itself at once) stays.
    """
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            *_, at, hashes = _scan(batch)
            gram, context, text, lo, hi = anchors_of(hashes, at, length, k)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), batch.column("doc_id").cast(pa.int64()).take(take), batch.column("row").take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                ["gram", "context", "doc_id", "row", "lo", "hi"],
            )

    suffixes = staged(map_batches(keyed, find, "gram long, context long, doc_id long, row long, lo int, hi int"))
    # written first: a join of two plain exchanges is one whose large partitions adaptive execution can split
    shared = staged(suffixes.groupBy("gram").agg(F.count("*").alias("n"), (F.min("context") != F.max("context")).alias("mixed")).where("n > 1").select("gram", "mixed"))
    candidates = staged(suffixes.join(shared, "gram"))
    discard(suffixes)
    place = F.struct("doc_id", "row", "lo", "hi")
    contexts = staged(candidates.groupBy("context", "gram").agg(F.min(place).alias("f"), F.count("*").alias("n"), F.first("mixed").alias("mixed")))
    again = contexts.where("n > 1").select("context", "gram", "f", F.col("mixed").alias("parts"))

    # copies of a whole context: all but the first are removable
    met = candidates.join(again, ["context", "gram"])
    same = (F.col("row") == F.col("f.row")) & F.col("doc_id").eqNullSafe(F.col("f.doc_id"))
    is_first = same & (F.col("lo") == F.col("f.lo"))
    begin = F.when(~is_first & same, F.greatest("lo", F.col("f.lo") + length)).otherwise(F.col("lo"))
    whole = met.where(~(is_first & F.col("parts"))).select("row", "doc_id", begin.alias("a"), (F.col("hi") + length).alias("b"), (~is_first).alias("removable"), F.col("f.doc_id").alias("first_doc"))

    # contexts that begin alike but differ: extend one suffix of each, window by window
    ranges = contexts.where("mixed").groupBy(F.col("f.row").alias("row"), F.col("f.doc_id").alias("of")).agg(F.collect_list(F.array(F.col("f.lo").cast("long"), F.col("f.hi").cast("long"), "n")).alias("ranges"))
    needed = keyed.join(ranges.withColumnRenamed("row", "its row"), (F.col("row") == F.col("its row")) & F.col("doc_id").eqNullSafe(F.col("of")))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            *_, at, hashes = _scan(batch)
            owned = batch.column("ranges")
            per = np.diff(owned.offsets.to_numpy())
            pairs = owned.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            text = np.repeat(np.arange(len(per)), per)
            count = pairs[:, 1] - pairs[:, 0] + 1
            s, of = expand(pairs[:, 0], count), np.repeat(text, count)
            begin = at[of] + s
            h, check = span_hashes(hashes, begin, begin + length), span_hashes(mix(hashes ^ SECOND), begin, begin + length)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), batch.column("doc_id").cast(pa.int64()).take(take), batch.column("row").take(take), pa.array(s.astype(np.int32)), pa.array(np.repeat(pairs[:, 2], count))], ["window", "check", "doc_id", "row", "s", "n"])

    windows = staged(map_batches(needed.select("doc_id", "row", "text", "ranges"), extend, "window long, check long, doc_id long, row long, s int, n long").distinct())
    twice = staged(windows.groupBy("window", "check").agg(F.min(F.struct("doc_id", "row", "s")).alias("f"), F.sum("n").alias("n")).where("n > 1").select("window", "check", "f"))
    met = windows.drop("n").join(twice, ["window", "check"])
    is_first = same & (F.col("s") == F.col("f.s"))
    begin = F.when(~is_first & same, F.greatest("s", F.col("f.s") + length)).otherwise(F.col("s"))
    single = met.select("row", "doc_id", begin.alias("a"), (F.col("s") + length).alias("b"), (~is_first).alias("removable"), F.col("f.doc_id").alias("first_doc"))
    return whole.union(single)


def _merged(spans: DataFrame) -> DataFrame:
    """Spans of a row that overlap or touch become one, for removable and kept ones apart."""
    w = Window.partitionBy("row", "doc_id", "removable").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # windows of one row are as many as the row's own words at most, however often the passage occurs
    parted = spans.where("a < b").groupBy("row", "doc_id", "removable", "a", "b").agg(F.min("first_doc").alias("first_doc"))
    parted = parted.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("part", F.sum("new").over(w))
    return parted.groupBy("row", "doc_id", "removable", "part").agg(F.min("a").alias("first_word"), F.max("b").alias("end_word"), F.sort_array(F.collect_set("first_doc")).alias("first_docs"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """One row for each maximal run of words that lie in passages of `length` words found elsewhere too.

    (doc_id, first_word, end_word, n_words, removable, first_docs): removable runs repeat what stands
    earlier, in the documents first_docs; the others are the first copies (first_docs then names the
    document itself). Documents without such passages, shorter than `length` words, empty or null have no
    row. Rows that repeat both doc_id and text count once; an empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as keep:
        merged = keep(_merged(repeats(docs, length, k)))
    return merged.select("doc_id", F.col("first_word").cast("long"), F.col("end_word").cast("long"), (F.col("end_word") - F.col("first_word")).cast("long").alias("n_words"), "removable", "first_docs")


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """docs with every repeat but the first cut from its text, and n_chars of what is left.

    Texts without repeats stay as they are, byte for byte. Rows of which no word is left are dropped.
    """
    with scratch(docs.sparkSession) as keep:
        merged = _merged(repeats(docs, length, k)).where("removable")
        per_row = keep(merged.groupBy(F.col("row").alias("its row"), F.col("doc_id").alias("of")).agg(F.collect_list(F.array("first_word", "end_word")).alias("cuts")))
    apart, renamed = set_apart(docs, "doc_id", "text", "n_chars")
    names = apart.columns
    same = (F.xxhash64("doc_id", "text") == F.col("its row")) & F.col("doc_id").eqNullSafe(F.col("of"))
    keyed = apart.join(per_row, same, "left").select(*names, "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, off = text_bytes(batch.column("text"))
            starts, _, at = words(LOWER[data], off, ALNUM)
            owned = batch.column("cuts")
            touched = np.array([x.is_valid for x in owned], bool)
            per = np.array([len(x) if x.is_valid else 0 for x in owned], np.int64)
            pairs = np.array([p for x in owned.to_pylist() if x for p in x], np.int64).reshape(-1, 2)
            text = np.repeat(np.arange(len(per)), per)
            nxt = np.append(starts, len(data))
            first, last = starts[at[text] + pairs[:, 0]], np.minimum(nxt[at[text] + pairs[:, 1]], off[1:][text])
            cleaned = cut_spans(data, off, first, last)
            left = np.diff(at)
            np.subtract.at(left, text, pairs[:, 1] - pairs[:, 0])
            old = batch.column("text").to_pylist()
            keep = ~touched | (left > 0)
            new = [c if t else o for c, t, o in zip(cleaned, touched.tolist(), old)]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(n) if t else o for n, t, o in zip(new, touched.tolist(), batch.column("n_chars").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns.values()], names).filter(pa.array(keep))

    back = {new: old for old, new in renamed.items()}
    return map_batches(keyed, cut, apart.schema).select(*(F.col(c).alias(back.get(c, c)) for c in names))

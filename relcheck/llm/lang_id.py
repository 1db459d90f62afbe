"""Language identification with bit-sliced Bloom filters of character n-grams.

The filter is an array of bit masks, one bit a language: the masks at the k hash positions of an
n-gram, and-ed, give all languages that (seem to) contain it at once. A text's score for a language is
the number of its n-grams with that bit, less the false positives expected from how full the
language's bit slice is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .textscan import map_batches, mix, per_text, slices, text_bytes

SIZES = (2, 3, 4)
HASHES = 3
SLOTS_LOG2 = 21
UNKNOWN = "und"
#: Bytes of text handled at once: n-grams take some 60 times as much.
SLICE = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 on division by 3: rows never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ngram_codes(column: pa.Array, sizes: tuple[int, ...] = SIZES) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Codes of all character n-grams of each text's lower-cased letters, words set apart by one space.

    For each size: codes, and where each text's codes begin; at last each text's number of letters.
    """
    texts = [" " + (t or "").lower() + " " for t in column.to_pylist()]
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64))])
    kinds = np.unique(flat)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    is_letter = letter[np.searchsorted(kinds, flat)]
    text_of = np.repeat(np.arange(len(texts)), np.diff(off))
    first = np.zeros(len(flat), bool)
    first[off[:-1]] = True
    keep = is_letter | first | np.concatenate([[False], is_letter[:-1]])
    symbol = np.where(is_letter, flat, 32)[keep].astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    text_of = text_of[keep]
    codes, begins = [], []
    for n in sizes:
        rows = max(len(symbol) - n + 1, 0)
        code = np.full(rows, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + symbol[k : k + rows]
        # within one text, and no space inside except at the ends
        ok = text_of[:rows] == text_of[n - 1 :]
        for k in range(1, n - 1):
            ok &= symbol[k : k + rows] != 32
        ok &= (symbol[:rows] != 32) | (symbol[n - 1 : n - 1 + rows] != 32)
        where = np.flatnonzero(ok)
        codes.append(mix(code[where]))
        begins.append(np.searchsorted(where, at))
    return codes, begins, per_text(is_letter, off)


def _slots(codes: np.ndarray, k: int, log2: int) -> np.ndarray:
    return (mix(codes + np.uint64(k)) >> np.uint64(64 - log2)).astype(np.int64)


class BitSlicedBloom:
    """One Bloom filter for each language, their bits side by side in arrays of masks, one for each 64 languages."""

    def __init__(self, languages: list[str], codes: np.ndarray, masks: np.ndarray, hashes: int = HASHES, log2: int = SLOTS_LOG2):
        """masks: a row for each code, a uint64 for each 64 languages."""
        self.languages, self.hashes, self.log2 = languages, hashes, log2
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        self.tables = [np.zeros(1 << log2, kind) for _ in range(-(-len(languages) // 64))]
        for table, mask in zip(self.tables, masks.T):
            for k in range(hashes):
                np.bitwise_or.at(table, _slots(codes, k, log2), mask.astype(kind))
        full = np.array([np.count_nonzero(self.tables[i // 64] & kind(1 << i % 64)) for i in range(len(languages))]) / (1 << log2)
        self.false_rate = full**hashes

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for k in range(self.hashes):
            at = _slots(codes, k, self.log2)
            found = [f & t[at] for f, t in zip(found, self.tables)] if k else [t[at] for t in self.tables]
        return found

    def hits(self, codes: list[np.ndarray], begins: list[np.ndarray]) -> np.ndarray:
        """Corrected counts: a row for each text, a column for each language."""
        out = np.zeros((len(begins[0]) - 1, len(self.languages)))
        for code, at in zip(codes, begins):
            found, n = self.masks(code), np.diff(at)
            for i in range(len(self.languages)):
                mask = found[i // 64]
                seen = per_text((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), at)
                out[:, i] += np.maximum(seen - n * self.false_rate[i], 0) / (1 - self.false_rate[i])
        return out


def learning_sample(docs: DataFrame, per_language: int) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, text) of the `per_language` rows of each with the least hash, none held out.

    One scan counts rows by language; another takes those whose hash is low enough for about twice as many, so
    that what is ranked is bounded however many rows a language has.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    counts = sorted((r[0], r[1]) for r in labelled.groupBy("lang").count().collect())  # a row for each language
    below = [(lang, min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, (2 * per_language + 50) / n)))) for lang, n in counts]
    bounds = docs.sparkSession.createDataFrame(below, "lang string, below long")
    near = labelled.join(F.broadcast(bounds), "lang").where(F.col("hash") <= F.col("below"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    return [lang for lang, _ in counts], near.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "text")


def learn(docs: DataFrame, per_language: int = 1500, least: int = 3, share: float = 0.25) -> BitSlicedBloom:
    """Learns which n-grams belong to which language from rows with a lang that are not held out.

    The sample is bounded: the `per_language` rows of each language with the least hash. An n-gram belongs
    to a language if it occurs `least` times in its sample and at no less than `share` of the rate that it
    has in the language where it is commonest.
    """
    names, sample = learning_sample(docs, per_language)
    number = {name: i for i, name in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            codes, begins, _ = ngram_codes(batch.column("text"))
            for code, at in zip(codes, begins):
                of = np.repeat(lang, np.diff(at))
                for i in np.unique(of).tolist():
                    values, n = np.unique(code[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(n), i, np.int32)), pa.array(n)], ["code", "lang", "n"])

    counts = map_batches(sample, count, "code long, lang int, n long").groupBy("code", "lang").agg(F.sum("n").alias("n"))
    table = counts.where(F.col("n") >= least).toPandas()  # bounded by the sample
    code, lang, n = table["code"].to_numpy(np.int64), table["lang"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    rate = n / np.maximum(np.bincount(lang, n, len(names)), 1)[lang]
    unique, which = np.unique(code, return_inverse=True)
    top = np.zeros(len(unique))
    np.maximum.at(top, which, rate)
    mine = rate >= share * top[which]
    masks = np.zeros((len(unique), -(-len(names) // 64)), np.uint64)
    np.bitwise_or.at(masks, (which[mine], lang[mine] // 64), np.uint64(1) << (lang[mine] % 64).astype(np.uint64))
    return BitSlicedBloom(names, unique.view(np.uint64), masks)


def told(docs: DataFrame, model: BitSlicedBloom) -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told by the whole text.

    Null texts, texts without a letter and texts of which no n-gram is known in any language go; where
    nothing has been learnt, only the first two.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            codes, begins, letters = ngram_codes(batch.column("text"))
            keep = letters > 0
            if shared.value.languages:
                keep &= shared.value.hits(codes, begins).max(axis=1) > 0
            yield batch.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)


def identify(docs: DataFrame, model: BitSlicedBloom, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with lang_pred and score (0 to 1), from the whole text alone.

    `und` and 0 for null texts and texts without a letter, and where nothing has been learnt. The
    score is the part of the text's evidence (corrected n-gram counts that not every language shares)
    that speaks for the predicted language; 0 if no n-gram is known. Ties go to the first name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        names = np.array([*bloom.languages, UNKNOWN], object)
        for batch in slices(batches, "text", SLICE):
            codes, begins, letters = ngram_codes(batch.column("text"))
            best, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if len(names) > 1:
                hits = bloom.hits(codes, begins)
                best = np.where(letters > 0, hits.argmax(axis=1), best)
                over = hits - hits.min(axis=1, keepdims=True) * (len(names) > 2)
                total = over.sum(axis=1)
                score = np.where((letters > 0) & (total > 0), over.max(axis=1) / np.maximum(total, 1e-9), 0)
            found = [pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"])
    columns = [*keep] + (["text"] if "text" not in keep else [])
    return map_batches(docs.select(*columns), run, schema)

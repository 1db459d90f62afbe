"""Benchmark decontamination with an FM-index for each shard of training texts.

A task indexes the texts of its shard (a few MB at a time): words that could lie in an occurrence are
numbered, sorted by suffix, and their Burrows-Wheeler transform is kept in a wavelet matrix, whose
ranks drive backward search. All test phrases are searched at once; occurrences are located from
sampled suffix positions and merged to spans. The benchmark is read in blocks of a stated size, and texts are
scanned for one block after another, so that only one is broadcast at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .packing import expand
from .textscan import ALNUM, LOWER, cut_spans, fits, map_batches, per_text, scratch, slices, span_hashes, staged, text_bytes, word_hashes, words

WINDOW = 10
SAMPLE = 8
#: Columns inside contamination(): two hashes that name a text, and what earlier blocks of the benchmark hit in it.
SAME_TEXT = ("text hash", "other text hash")
SO_FAR = ("spans so far", "items so far")


class Windows:
    """The distinct windows of a block of benchmark items, as word numbers, and the items of each."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW):
        data, off = text_bytes(pa.array(texts, pa.string()))
        data = LOWER[data]
        starts, ends, at = words(data, off, ALNUM)
        hashes = word_hashes(data, starts, ends)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        n_words = np.diff(at)
        n_windows = np.where(n_words > 0, np.maximum(n_words - window + 1, 1), 0)
        item = np.repeat(np.arange(len(ids)), n_windows)
        first = expand(at[:-1], n_windows)
        length = np.minimum(n_words, window)[item]
        keys = span_hashes(hashes, first, first + length) if len(first) else np.zeros(0, np.uint64)
        _, where, which = np.unique(keys, return_index=True, return_inverse=True)
        self.length = length[where]
        self.symbols = np.zeros((len(where), window), np.int64)
        for k in range(window):
            use = self.length > k
            self.symbols[use, k] = numbers[first[where[use]] + k] + 1
        pairs = np.unique(np.stack([which, item], axis=1), axis=0) if len(which) else np.zeros((0, 2), np.int64)
        self.item_at = np.searchsorted(pairs[:, 0], np.arange(len(where) + 1))
        self.items = pairs[:, 1]
        self.item_ids = np.array([None if x is None else str(x) for x in ids], object)
        use = np.arange(window - 1)[None, :] < (self.length - 1)[:, None]
        left, right = self.symbols[:, :-1][use], self.symbols[:, 1:][use]
        self.bigrams = np.unique(left * (len(self.vocabulary) + 1) + right)
        self.shortest = int(self.length.min()) if len(where) else 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number (from 1) of each word, 0 for words that no item has."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def possible(self, numbers: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """Words in runs where every two neighbours are neighbours in some window too, as long as the shortest window."""
        if self.shortest <= 1:
            return numbers > 0
        key = numbers[:-1] * (len(self.vocabulary) + 1) + numbers[1:]
        at = np.minimum(np.searchsorted(self.bigrams, key), len(self.bigrams) - 1)
        linked = np.zeros(len(numbers) + 1, np.int8)
        linked[1:-1] = (self.bigrams[at] == key) & (text_of[:-1] == text_of[1:]) & (numbers[:-1] > 0) & (numbers[1:] > 0)
        change = np.diff(linked, prepend=0, append=0)
        begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = end - begin + 1 >= self.shortest
        keep = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(keep, begin[long] - 1, 1)
        np.add.at(keep, end[long], -1)
        return np.cumsum(keep[:-1]) > 0


class FMIndex:
    """Backward search over a text of positive integers; 0 is kept for its end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text, 0)
        n = len(text)
        order, rank, width = np.argsort(text, kind="stable"), None, 1
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        while True:  # prefix doubling: ranks by the first 1, 2, 4, ... symbols
            ahead = np.full(n, -1, np.int64)
            ahead[:-width] = rank[width:]
            key = rank * (n + 1) + ahead + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
            rank, width = new, 2 * width
            if rank[order[-1]] == n - 1 or width >= n:
                break
        bwt = text[order - 1]
        self.levels = max(1, int(text.max()).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.levels))])
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before the given row."""
        begin, end = np.zeros_like(upto), upto
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbol >> level) & 1
            one_b, one_e = self.ones[i][begin], self.ones[i][end]
            begin = np.where(bit, self.zeros[i] + one_b, begin - one_b)
            end = np.where(bit, self.zeros[i] + one_e, end - one_e)
        return end - begin

    def symbol(self, row: np.ndarray) -> np.ndarray:
        value = np.zeros_like(row)
        for i in range(self.levels):
            bit = self.ones[i][row + 1] - self.ones[i][row]
            value = value * 2 + bit
            row = np.where(bit, self.zeros[i] + self.ones[i][row], row - self.ones[i][row])
        return value

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes begin with each pattern; empty if none does."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.sampled), np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            go = np.flatnonzero((length > k) & (low < high))
            c = patterns[go, k]
            known = c < len(self.before) - 1
            low[go[~known]] = high[go[~known]] = 0
            go, c = go[known], c[known]
            low[go] = self.before[c] + self.rank(c, low[go])
            high[go] = self.before[c] + self.rank(c, high[go])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows, by steps back to a sampled one."""
        out, steps = np.zeros_like(rows), np.zeros_like(rows)
        left, row = np.arange(len(rows)), rows.copy()
        while len(left):
            done = self.sampled[row]
            out[left[done]] = self.samples[self.sample_rank[row[done]]] + steps[left[done]]
            left, row = left[~done], row[~done]
            steps[left] += 1
            c = self.symbol(row)
            row = self.before[c] + self.rank(c, row)
        return out


def scan(data: np.ndarray, off: np.ndarray, block: Windows) -> dict[str, np.ndarray]:
    """For texts in one buffer: words, the hit words, and the (text, item) pairs that match."""
    data = LOWER[data]
    starts, ends, at = words(data, off, ALNUM)
    text_of = np.repeat(np.arange(len(off) - 1), np.diff(at))
    hit, pairs = np.zeros(len(starts), bool), np.zeros((0, 2), np.int64)
    if len(starts) and len(block.length):
        numbers = block.numbers(word_hashes(data, starts, ends))
        kept = np.flatnonzero(block.possible(numbers, text_of))
        if len(kept):
            # kept words, with a separator wherever something was left out or a text ends
            gap = np.flatnonzero((np.diff(kept) > 1) | (np.diff(text_of[kept]) > 0)) + 1
            separator = len(block.vocabulary) + 1
            index = FMIndex(np.insert(numbers[kept], gap, separator))
            place = np.insert(kept, gap, -1)
            low, high = index.search(block.symbols, block.length)
            window = np.repeat(np.arange(len(low)), high - low)
            word = place[index.locate(expand(low, high - low))]
            mark = np.zeros(len(starts) + 1, np.int64)
            np.add.at(mark, word, 1)
            np.add.at(mark, word + block.length[window], -1)
            hit = np.cumsum(mark[:-1]) > 0
            found = np.unique(np.stack([text_of[word], window], axis=1), axis=0)
            items = block.items[expand(block.item_at[found[:, 1]], np.diff(block.item_at)[found[:, 1]])]
            texts = np.repeat(found[:, 0], np.diff(block.item_at)[found[:, 1]])
            pairs = np.unique(np.stack([texts, items], axis=1), axis=0)
    return {"starts": starts, "ends": ends, "at": at, "text_of": text_of, "hit": hit, "pairs": pairs}


def _runs(hit: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of each run of hit words within a text."""
    before = np.concatenate([[False], hit[:-1] & (text_of[1:] == text_of[:-1])]) if len(hit) else hit
    after = np.concatenate([hit[1:] & (text_of[1:] == text_of[:-1]), [False]]) if len(hit) else hit
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = 16_000_000) -> Iterator[Windows]:
    """Reads the benchmark in blocks of at most `block_chars` characters (one item at least).

    Items stream to the driver block by block and leave it as broadcasts of that bounded size. The last
    block, the only one of an empty benchmark, may be empty.
    """
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if ids and size + len(r[1]) > block_chars:
            yield Windows(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
    yield Windows(ids, texts, window)


def _marked(spans: pa.Array, at: np.ndarray) -> np.ndarray:
    """Which words lie in the spans (first word, last word + 1) of their text."""
    counts = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
    pairs = spans.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2) + np.repeat(at[:-1], counts)[:, None]
    change = np.zeros(at[-1] + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean_text: bool = False, keep: tuple[str, ...] = (), most_broadcast: int = 2_000_000) -> DataFrame:
    """Benchmark windows in every whole text of docs: one row per row of docs.

    doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated,
    spans (list of [first word, last word + 1]); with clean_text also clean: the text without the spans.
    Null and empty texts have no words; repeated rows stay; an empty benchmark hits nothing. Words of items
    with a null id are hit, but such items are neither counted nor named; repeated items count once. `keep`
    names further columns of docs to carry along. docs is read once for each block of the benchmark; of every
    block but the last the spans and items of the texts it hits are written, once for equal texts, and join
    those texts in the last pass. Texts are never written again, and only those hit are shuffled (all of them
    if more than `most_broadcast` different ones are hit). Equal texts are told by 128 bits of their hashes.
    """
    extra = [c for c in keep if c not in ("doc_id", "text")]
    kinds = {f.name: f for f in docs.schema.fields}
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>"
    schema += ", clean string" * clean_text + "".join(f", `{c}` {kinds[c].dataType.simpleString()}" for c in extra)

    def hits(batch: pa.RecordBatch, block: Windows) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, pa.Array, list[set]]:
        """A scan of the batch's texts and, with what earlier blocks hit, its hit words, its runs, their spans, and the items of each text."""
        data, off = text_bytes(batch.column("text"))
        base = scan(data, off, block)
        at, hit, items = base["at"], base["hit"], [set() for _ in range(len(off) - 1)]
        if SO_FAR[0] in batch.schema.names:
            hit = hit | _marked(batch.column(SO_FAR[0]), at)
            items = [set(x) for x in batch.column(SO_FAR[1]).to_pylist()]
        for text, item in base["pairs"].tolist():
            items[text].add(block.item_ids[item])
        begin, end = _runs(hit, base["text_of"])
        of = base["text_of"][begin]
        spans = ragged_pairs(np.stack([begin, end], axis=1) - at[of][:, None], np.bincount(of, minlength=len(off) - 1))
        return base | {"hit": hit, "data": data, "off": off}, begin, end, spans, [x - {None} for x in items]

    def part(shared: Broadcast) -> Callable:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                base, _, _, spans, items = hits(batch, shared.value)
                columns = [*(batch.column(c) for c in SAME_TEXT), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*SAME_TEXT, *SO_FAR]).filter(pa.array(per_text(base["hit"], base["at"]) > 0))

        return each

    def whole(shared: Broadcast) -> Callable:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):  # one index a slice
                base, begin, end, spans, items = hits(batch, shared.value)
                data, off, n_hit = base["data"], base["off"], per_text(base["hit"], base["at"])
                digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
                columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(base["at"])), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(n_hit > 0), spans]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]
                if clean_text:
                    # a span goes with what stands between it and the next word of its text
                    nxt = np.append(base["starts"], len(data))[end]
                    columns.append(pa.array(cut_spans(data, off, base["starts"][begin], np.minimum(nxt, off[1:][base["text_of"][begin]])), pa.string()))
                    names.append("clean")
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in extra)], [*names, *extra])

        return each

    spark, found = docs.sparkSession, docs.select("doc_id", "text", *(F.col(f"`{c}`") for c in extra))
    blocks = benchmark_blocks(benchmark, window)
    block = next(blocks)
    named = dict(zip(SAME_TEXT, (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))))
    with scratch(spark) as outlive:
        parts = []
        for following in blocks:
            shared = spark.sparkContext.broadcast(block)
            texts = docs.where("text IS NOT NULL").select("text", *(c.alias(name) for name, c in named.items()))
            met = map_batches(texts, part(shared), "".join(f"`{c}` long, " for c in SAME_TEXT) + f"`{SO_FAR[0]}` array<array<int>>, `{SO_FAR[1]}` array<string>")
            # equal texts are hit alike, so copies leave one row, before the shuffle
            parts.append(staged(met.groupBy(*SAME_TEXT).agg(*(F.min(f"`{c}`").alias(c) for c in SO_FAR))))
            shared.destroy()
            block = following
        if parts:
            every = spark.read.schema(parts[0].schema).parquet(*(x.staged_path for x in parts))
            every = outlive(every.groupBy(*SAME_TEXT).agg(*(F.flatten(F.collect_list(f"`{c}`")).alias(c) for c in SO_FAR)))
            hit = fits(every.select(*SAME_TEXT), most_broadcast)
            keyed = found.withColumns(named)
            none = {c: F.array().cast(every.schema[c].dataType) for c in SO_FAR}
            found = keyed.join(hit, [*SAME_TEXT], "left_semi").join(every, [*SAME_TEXT]).unionByName(keyed.join(hit, [*SAME_TEXT], "left_anti").withColumns(none)).drop(*SAME_TEXT)
    return map_batches(found, whole(spark.sparkContext.broadcast(block)), schema)


def ragged_pairs(spans: np.ndarray, per: np.ndarray) -> pa.Array:
    inner = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(spans) + 1, 2), pa.int32()), pa.array(spans.ravel(), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), inner)

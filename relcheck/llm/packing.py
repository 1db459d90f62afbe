"""Best-fit packing of token sequences by exact-complement hashing.

Tasks tokenise texts and cut them into pieces. What to put together depends only on how many pieces
there are of each length, a table of at most `capacity` rows however large the corpus, so the plan is
made from that table on the driver: the largest remaining length takes the single, pair or triple of
other lengths that fills its gap exactly, as often as all of them last; what no exact sum fits goes by
best fit. Spark then numbers the pieces of each length and joins them to the plan's slots.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textscan import map_batches, slices, staged, text_bytes, word_hashes

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Encoder:
    """Token ids of texts by a byte-level BPE file, with each distinct chunk of text encoded once.

    The pre-tokeniser never joins a non-space to the white space after it, so a text may be cut
    before each run of ASCII white space, and equal chunks have equal ids. Ids of up to `most`
    chunks are kept by their 64-bit hash. A special token's string in a text is that token.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token)
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.first = np.zeros(0, np.uint64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where chunks begin: at texts' starts and before ASCII white space that follows none."""
        n = len(data)
        space = _ASCII_SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[1:n] = space[1:] & ~space[:-1]
        # not after other Unicode white space: U+0085 and U+00A0 have lead byte C2, the rest E1 to E3
        cut[2:n] &= data[: max(n - 2, 0)] != 0xC2
        cut[3:n] &= (data[: max(n - 3, 0)] < 0xE1) | (data[: max(n - 3, 0)] > 0xE3)
        cut[off] = True
        return np.flatnonzero(cut[:n])

    def _encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and the number of ids of each."""
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        # a chunk without leading white space may only stand first in a string that is encoded
        lead = _ASCII_SPACE[data[starts]] & ~_ASCII_SPACE[data[ends - 1]]
        third = data[np.maximum(ends - 3, 0)]
        lead &= (data[np.maximum(ends - 2, 0)] != 0xC2) & ((third < 0xE1) | (third > 0xE3))
        joined = [p for p, ok in zip(parts, lead.tolist()) if ok]
        alone = [p for p, ok in zip(parts, lead.tolist()) if not ok]
        groups = [b"".join(joined[i : i + 4000]) for i in range(0, len(joined), 4000)]
        found = self.tokenizer.encode_batch_fast([g.decode() for g in [*groups, *alone]], add_special_tokens=False)
        counts = np.zeros(len(parts), np.int64)
        ids_joined = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found[: len(groups)])])
        ends_of = np.cumsum(self.width[ids_joined])
        sizes = np.cumsum([len(p) for p in joined]) if joined else np.zeros(0, np.int64)
        upto = np.searchsorted(ends_of, sizes, "right")
        counts[lead] = np.diff(upto, prepend=0)
        ids_alone = [np.array(e.ids, np.uint32) for e in found[len(groups) :]]
        counts[~lead] = [len(x) for x in ids_alone]
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        ids = np.zeros(at[-1], np.uint32)
        of = np.repeat(lead, counts)
        ids[of] = ids_joined
        ids[~of] = np.concatenate([np.zeros(0, np.uint32), *ids_alone])
        return ids, counts

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of ids of each text."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        starts = self._chunks(data, off)
        ends = np.append(starts[1:], len(data))
        keys = word_hashes(data, starts, ends)
        unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
        new = ~np.isin(unique, self.hashes, assume_unique=True)
        if new.any():
            if len(self.hashes) + new.sum() > self.most:
                self.clear()
                new[:] = True
            ids, counts = self._encode_new(data, starts[where[new]], ends[where[new]])
            all_counts = np.concatenate([np.diff(self.first), counts])
            all_first = np.concatenate([self.first[:-1], self.first[-1] + np.cumsum(counts) - counts])
            hashes, self.ids = np.concatenate([self.hashes, unique[new]]), np.concatenate([self.ids, ids])
            order = np.argsort(hashes, kind="stable")
            self.hashes = hashes[order]
            self.ids = self.ids[expand(all_first[order], all_counts[order])]
            self.first = np.concatenate([[0], np.cumsum(all_counts[order])])
        at = np.searchsorted(self.hashes, unique)[back]
        first, counts = self.first[at], np.diff(self.first)[at]
        total = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, off)]
        return self.ids[expand(first, counts)], np.diff(total)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a file, for as long as a Python worker lives: loading one takes as long as a few MB of text."""
    return Encoder(path)


def expand(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... counts[0] of them, then those of the next."""
    at = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(first - at, counts)


def cut_pieces(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each piece of texts with these counts of ids: text, number, start, length. All but a first are full."""
    pieces = -(-counts // capacity)
    text = np.repeat(np.arange(len(counts)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = counts - (pieces - 1) * capacity
    start = np.where(number == 0, 0, first[text] + (number - 1) * capacity)
    return text, number, start, np.where(number == 0, first[text], capacity)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece of each text: doc_id, piece, start, length, ids_crc32. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(tokenizer_path)
        for batch in slices(batches, "text"):
            data, off = text_bytes(batch.column("text"))
            flat, counts = encode(data, off)
            ids = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
            text, number, start, length = cut_pieces(counts + 1, capacity)
            base = (np.cumsum(counts + 1) - counts - 1)[text] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(base.tolist(), length.tolist())]
            keys = batch.column("doc_id").cast(pa.int64()).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), run, PIECES)


Plan = list[tuple[tuple[int, ...], int]]


def exact_fills(counts: np.ndarray, capacity: int) -> tuple[Plan, np.ndarray]:
    """Patterns of one to four pieces that fill a sequence exactly, the largest piece first, and the counts of what is left."""
    left = counts.astype(np.int64).copy()
    plan: Plan = []

    def pair_sums() -> np.ndarray:
        here = (left > 0).astype(np.float64)
        n = 1 << (2 * len(here) - 1).bit_length()
        return np.rint(np.fft.irfft(np.fft.rfft(here, n) ** 2, n))[: capacity + 1] > 0

    def single(gap: int) -> list[tuple[int, ...]]:
        return [(gap,)] if left[gap] > 0 else []

    def pair(gap: int) -> list[tuple[int, ...]]:
        a = np.arange(gap // 2, gap)
        a = a[(a > 0) & (left[a] > 0) & (left[gap - a] > 0)]
        a = a[(a != gap - a) | (left[a] > 1)]
        return [(int(a[-1]), int(gap - a[-1]))] if len(a) else []

    def take(lengths: tuple[int, ...]) -> bool:
        kinds, need = np.unique(lengths, return_counts=True)
        times = int((left[kinds] // need).min())
        if times:
            left[kinds] -= need * times
            plan.append((lengths, times))
        return times > 0

    sums, alive = pair_sums(), int((left > 0).sum())
    rest = np.zeros(capacity + 1, np.int64)
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            gap = capacity - length
            if gap == 0:
                take((length,))
                continue
            done = any(take((length, *x)) for x in single(gap))
            if not done and sums[gap]:
                done = any(take((length, *x)) for x in pair(gap))
            if not done:
                for a in np.flatnonzero((left[:gap] > 0) & sums[gap:0:-1])[::-1].tolist():
                    if any(take((length, a, *x)) for x in pair(gap - a)):
                        done = True
                        break
            if not done:
                rest[length] += left[length]
                left[length] = 0
            if (now := int((left > 0).sum())) != alive:
                sums, alive = pair_sums(), now
    return plan, rest


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best fit, the largest pieces first: each goes where it leaves the least room. Equal sequences are handled as one."""
    plan: Plan = []
    open_by_gap: dict[int, Plan] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap == 0:
            plan.append((lengths, times))
        else:
            open_by_gap.setdefault(gap, []).append((lengths, times))
            gaps[gap] = True

    for length in range(capacity, 0, -1):
        todo = int(counts[length])
        while todo:
            fit = np.flatnonzero(gaps[length:])
            if len(fit):
                gap = length + int(fit[0])
                lengths, times = open_by_gap[gap].pop()
                gaps[gap] = bool(open_by_gap[gap])
                each = min(gap // length, todo)
                used = min(times, todo // each)
                put(lengths + (length,) * each, used)
                if used < times:
                    put(lengths, times - used)
            else:
                each = min(capacity // length, todo)
                put((length,) * each, used := todo // each)
            todo -= used * each
    return plan + [x for group in open_by_gap.values() for x in group]


def plan_sequences(counts: np.ndarray, capacity: int) -> Plan:
    """Patterns of lengths and how many sequences follow each, using counts[length] pieces of every length.

    counts has capacity + 1 entries. Its size bounds all work here; the corpus does not. Exact fills, then
    best fit of the rest; but exact fills can use up the small pieces that large ones need. So fills are
    also tried among the pieces over a half, a third and a quarter only, and none at all, and the plan of the
    fewest sequences is kept: never more than best fit alone needs.
    """
    def planned(least: int) -> Plan:
        held = np.where(np.arange(capacity + 1) < least, counts, 0)
        plan, rest = exact_fills(counts - held, capacity)
        return plan + best_fit(rest + held, capacity)

    plans = [planned(least) for least in (1, capacity // 4 + 1, capacity // 3 + 1, capacity // 2 + 1)] + [best_fit(counts, capacity)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to capacity tokens, each sequence gapless from 0.

    The plan has a bounded size (see plan_sequences), and so has its broadcast. Pieces are numbered
    within (length, salt), so a length that a third of all pieces have is shared by many tasks. The salt is
    a row's place, written with the pieces: equal rows, however many, are dealt apart.
    """
    spark = pieces.sparkSession
    salted = staged(pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")))
    found = salted.groupBy("length", "salt").count().collect()
    counts, base = np.zeros(capacity + 1, np.int64), []
    for r in sorted(found):
        base.append((r["length"], r["salt"], int(counts[r["length"]])))
        counts[r["length"]] += r["count"]
    slots, sequence, used = [], 0, np.zeros(capacity + 1, np.int64)
    for lengths, times in plan_sequences(counts, capacity):
        at = 0
        for n in lengths:
            slots.append((int(n), int(used[n]), int(used[n]) + times, sequence, at))
            used[n] += times
            at += n
        sequence += times
    by_length: dict[int, list] = {}
    for n, low, high, seq, at in sorted(slots):
        by_length.setdefault(n, []).append((low, high, seq, at))
    base_df = spark.createDataFrame(base, "length long, salt int, base long")
    numbered = (
        salted.withColumn("nth", F.expr("row_number() over (partition by length, salt order by doc_id, piece, ids_crc32)"))
        .join(F.broadcast(base_df), ["length", "salt"])
        .withColumn("nth", F.col("nth") - 1 + F.col("base"))
    )
    columns = {n: tuple(np.array(c, np.int64) for c in zip(*rows)) for n, rows in by_length.items()}
    shared = spark.sparkContext.broadcast(columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, nth = (batch.column(c).to_numpy() for c in ("length", "nth"))
            seq, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length).tolist():
                low, _, first, at = plan[n]
                here = np.flatnonzero(length == n)
                slot = np.searchsorted(low, nth[here], "right") - 1
                seq[here], offset[here] = first[slot] + nth[here] - low[slot], at[slot]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kept = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "nth")
    return map_batches(kept, place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents' texts into sequences of at most `capacity` tokens.

    Null and empty texts are one piece holding the end id alone; repeated rows are packed as often as
    they occur; an empty table gives an empty result; columns besides doc_id and text are not read.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces_of(docs, tokenizer_path, capacity), capacity)

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings, strategies as st
from tokenizers import Tokenizer

from relcheck.llm import packing as P
from relcheck.llm.textscan import text_bytes
import pyarrow as pa

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    return P.Encoder(PATH, most=500)


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return t


ODD = [
    "", " ", "\n\n", "a", " a  b\n\n c ", "x   y", "    z", "été à l'été  d' ", "it's  we'll\tthey've",
    "<|endoftext|> x <|endoftext|>", "日本語 の  文字 列", "é ́", "a\u0085  b", "1234 5.6  7", "!!  ?? --", "\r\n\r\n x", "\x1c \x1d y", "🎉🎉 🎉",
]


def check_ids(encode, plain, texts):
    flat, counts = encode(*text_bytes(pa.array(texts, pa.string())))
    at = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_ids_are_the_tokenizers_own(encode, plain):
    check_ids(encode, plain, ODD)
    check_ids(encode, plain, [None, "a b", None, "a b" * 1000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'sé \u0085 \n\t.1語"), max_size=30), max_size=8))
def test_ids_of_any_text(encode, plain, texts):
    check_ids(encode, plain, texts)


def sequences(counts):
    plan = P.plan_sequences(counts, len(counts) - 1)
    used = np.zeros_like(counts)
    for lengths, times in plan:
        assert times > 0 and 0 < sum(lengths) <= len(counts) - 1
        for n in lengths:
            used[n] += times
    assert (used == counts).all()
    return sum(t for _, t in plan)


def least_bound(counts):
    """No packing has fewer sequences: dual feasible functions (Fekete and Schepers), which include Martello and Toth's L2."""
    capacity, best = len(counts) - 1, 0
    x = np.arange(capacity + 1)
    for t in range(capacity // 2 + 1):
        u = np.where(x > capacity - t, capacity, np.where(x < t, 0, x))
        best = max(best, -(-int((counts * u).sum()) // capacity))
        for k in range(1, 21):
            scaled = np.where((k + 1) * u % capacity == 0, k * u, (k + 1) * u // capacity * capacity)  # times capacity * k
            best = max(best, -(-int((counts * scaled).sum()) // (capacity * k)))
    return best


def fewest(sizes, capacity):
    """The optimum, by trying every place for each piece."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 64), st.integers(1, 50)), max_size=30))
@example([(22, 15), (43, 16)])
@example([(2, 6), (30, 6), (33, 7)])
def test_plan_uses_each_piece_once_and_packs_well(found):
    counts = np.zeros(65, np.int64)
    for n, c in found:
        counts[n] += c
    least = least_bound(counts)
    assert least <= sequences(counts) <= 11 / 9 * least + 1
    assert sequences(counts) <= sum(times for _, times in P.best_fit(counts, 64))


def test_small_pieces_are_held_back_for_large_ones():
    counts = np.bincount([2] * 6 + [30] * 6 + [33] * 7, minlength=65)
    assert sequences(counts) == 7


def thue_morse(n):
    """Two texts of n letters that differ everywhere, which power sums modulo 2^64 can't tell apart."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 65536])
def test_long_chunks_are_told_apart(encode, plain, n):
    x, y = thue_morse(n)
    check_ids(encode, plain, [x, y, x + " " + y, y])


def test_rows_that_repeat_are_dealt_apart(spark):
    docs = spark.range(3000).selectExpr("7L AS doc_id", "'x y z' AS text")
    rows = P.pack_documents(docs).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    n = rows[0]["length"]
    assert len(rows) == len(places) == 3000 and len({s for s, _ in places}) == -(-3000 // (2048 // n))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_plan_of_few_pieces_is_close_to_the_optimum(sizes):
    counts = np.bincount(np.array(sizes, np.int64), minlength=21)
    most = fewest(sorted(sizes, reverse=True), 20)
    assert least_bound(counts) <= most <= sequences(counts) <= 11 / 9 * most + 1


def test_plan_finds_exact_triples():
    counts = np.zeros(2049, np.int64)
    for n in (1500, 300, 200, 48, 1000, 1048, 2048):
        counts[n] = 7
    assert sequences(counts) == 21


def test_documents_round_trip(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-3, "a"), (-4, "word " * 9000)], "doc_id long, text string"))
    rows = P.pack_documents(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r[0], []).append(r[1])
    by_seq = {}
    seen = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault((r["doc_id"], r["piece"]), []).append(r)
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    total = 0
    for doc, ts in texts.items():
        ids = [*plain.encode(ts[0] or "", add_special_tokens=False).ids, 0]
        total += len(ids) * len(ts)
        n = -(-len(ids) // 2048)
        first = len(ids) - (n - 1) * 2048
        for k in range(n):
            a, b = (0, first) if k == 0 else (first + (k - 1) * 2048, first + k * 2048)
            got = seen.pop((doc, k))
            assert len(got) == len(ts)
            for r in got:
                assert (r["start"], r["length"], r["ids_crc32"]) == (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert not seen
    assert len(by_seq) <= 1.02 * -(-total // 2048) + 1


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string, offset int")).count() == 0

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from relcheck.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, window=10):
    w = WORD.findall(lower(text))
    hit, ids = [False] * len(w), set()
    for item, t in items:
        v = WORD.findall(lower(t))
        for p in range(max(1, len(v) - window + 1)) if v else []:
            win = v[p : p + window]
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    ids.add(str(item))
                    hit[i : i + len(win)] = [True] * len(win)
    return len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_long_words_are_told_apart(spark):
    x = "a"
    while len(x) < 2048:  # power sums modulo 2^64 can't tell these apart
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, x), (2, y), (3, x + " " + y)], [(1, x)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 5), min_size=1, max_size=5), min_size=1, max_size=6))
def test_index_counts_and_locates(text, patterns):
    index = D.FMIndex(np.array(text), sample=4)
    width = max(map(len, patterns))
    table = np.array([p + [0] * (width - len(p)) for p in patterns])
    low, high = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text)) if text[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def check(spark, docs, items, window=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(d, b, window, clean_text=True).collect()
    assert len(got) == len(docs)
    texts = {}
    for k, t in docs:
        texts.setdefault(k, t)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute(t, items, window), r
        assert r["contaminated"] == (r["n_hit"] > 0) and sum(b - a for a, b in r["spans"]) == r["n_hit"]
        keep = WORD.findall(lower(t))
        for a, b in sorted(map(tuple, r["spans"]), reverse=True):
            del keep[a:b]
        assert WORD.findall(lower(r["clean"])) == keep
    return got


def test_small_vocabulary_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "cé", "d9"])
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 7)))) for k in (10, 9, 2, 33)] + [(4, None), (5, "?!"), (9, "a B")]
    docs = [(k, rng.choice([", ", " ", "\n"]).join(word() for _ in range(rng.randint(0, 40)))) for k in range(60)] + [(99, None), (98, "")]
    check(spark, docs, items, window=4)
    check(spark, docs, [(1, "a B cé d9 a a"), (2, "d9 d9 B a cé cé cé")], window=4)


def test_whole_table(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:80]
    item = items[3][1]
    docs += [(7001, "Before it. " + item.upper() + " and after"), (7001, "Before it. " + item.upper() + " and after"), (7002, item[: len(item) // 2])]
    got = check(spark, docs, items)
    assert sum(r["contaminated"] for r in got) >= 3


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(docs, none).collect()
    assert [(r["n_words"], r["n_hit"], r["items_sha256"]) for r in got] == [(2, 0, hashlib.sha256(b"").hexdigest()), (0, 0, hashlib.sha256(b"").hexdigest())]
    assert D.contamination(docs.limit(0), none).count() == 0


def test_blocks_give_what_one_block_gives(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(str, D.contamination(docs, bench).collect()))
    real = D.benchmark_blocks
    monkeypatch.setattr(D, "benchmark_blocks", lambda b, w: real(b, w, block_chars=2000))
    assert len(list(D.benchmark_blocks(bench, 10))) >= 3
    assert sorted(map(str, D.contamination(docs, bench).collect())) == whole


def test_items_without_an_id_hit_but_have_no_name(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four", 7), (2, "five six", 8), (None, "null seven", 9)], "doc_id long, text string, `items so far` int")
    items = spark.createDataFrame([(None, "two three"), ("null", "null seven"), ("b", "five six"), ("b", "five six")], "item_id string, text string")
    name = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(1, 2, 0, name(""), True), (2, 2, 1, name("b"), True), (None, 2, 1, name("null"), True)]
    real = D.benchmark_blocks
    for chars in (1000, 5):
        monkeypatch.setattr(D, "benchmark_blocks", lambda b, w, c=chars: real(b, w, block_chars=c))
        got = D.contamination(docs, items, 2).select("doc_id", "n_hit", "n_items", "items_sha256", "contaminated")
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0] or 99) == want


def test_blocks_write_hits_once_for_equal_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three", "x"), (1, "one two three", "y"), (None, "one two three", None), (2, "five six one two", "z"), (3, "nothing", "w"), (4, None, "v"), (5, "", "u")], "doc_id long, text string, more string")
    items = spark.createDataFrame([("a", "one two"), ("b", "five six"), ("c", "two three")], "item_id string, text string")
    run = lambda most: sorted(map(str, D.contamination(docs, items, 2, clean_text=True, keep=("more",), most_broadcast=most).collect()))
    whole, written = run(10), []
    real, write = D.benchmark_blocks, D.staged

    def watched(df):
        out = write(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(D, "benchmark_blocks", lambda b, w: real(b, w, block_chars=5))
    monkeypatch.setattr(D, "staged", watched)
    assert run(10) == run(0) == whole
    assert all(columns == [*D.SAME_TEXT, *D.SO_FAR] for columns, _ in written)
    assert [rows for _, rows in written] == [2, 1] * 2  # "one two" in two different texts, "five six" in one; "two three" is left to the last pass

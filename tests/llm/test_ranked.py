import math
import random
import re
from collections import Counter

from relcheck.llm import ranked as M

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for i, asked in wanted.items():
        found = []
        for d, b, n in bags:
            m = 50 + 50 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in asked & set(b))
            if s > 0:
                found.append((-s, d is not None, d or 0, d))
        out |= {(i, r, d, -s) for r, (s, *_, d) in enumerate(sorted(found)[:k], 1)}
    return out


def check(spark, docs, items, k=50, parts=3, **more):
    rows = M.rank_documents(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), k, **more).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows) and got == brute(docs, items, k)


def test_whole_table_in_any_shards_and_bundles(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)
    check(spark, docs, items, 7, shard_bytes=20_000, shard_docs=13, bundle_items=3, most_terms=5)


def test_ties_go_by_id_across_shards(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a b", "a c c", "B", "d a e f"])) for i in rng.sample(range(500), 300)]
    check(spark, docs, [(1, "a b"), (2, "b"), (3, "e zz"), (4, "zz")], 20, parts=4, shard_docs=16)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    long = " ".join(f"w{i % 3000}" for i in range(40_000)) + " " + "y" * 100_000
    docs = [(1, None), (2, ""), (3, "-- !"), (4, "a b"), (4, "a b"), (None, "a b"), (6, long), (7, "É" + "y" * 10), (8, "y" * 100_000), (9, "É a 1"), (-2, "É A"), (5, "x")]
    items = [(1, "a É w7 1"), (None, "b"), (None, "a"), (2, None), (3, ""), (4, "y" * 100_000), (5, "a"), (5, "b"), (5, "b"), (6, "q")]
    check(spark, docs, items)
    check(spark, docs, items, 2, shard_bytes=1)
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((none_docs, none_items), (none_docs, some[1]), (some[0], none_items), (spark.createDataFrame([(1, None), (2, "?")], DOCS), some[1])):
        assert M.rank_documents(d, i).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "s"), (2, "c", 4, "t")], DOCS + ", shard long, term string")
    items = spark.createDataFrame([(1, "a", 9)], ITEMS + ", bundle int")
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in M.rank_documents(docs, items).collect()] == [(1, 1, 1)]


def test_long_words_are_told_apart(spark):
    x = "a"
    while len(x) < 4096:  # power sums modulo 2^64 can't tell these apart
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, x), (2, y), (3, "a")], [(1, x), (2, y)])

import math
import re
from collections import Counter, defaultdict

from relcheck.llm import bm25 as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, queries, k):
    bags = [(d, Counter(split(t)), len(split(t))) for d, t in docs]
    mean = sum(n for *_, n in bags) / len(bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    out = {}
    for q, t in queries:
        found = []
        for d, bag, n in bags:
            s = sum(math.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * 2.2 / (bag[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in set(split(t)) if w in bag)
            if s > 0:
                found.append((-s, d if d is not None else -math.inf, d))
        out[q] = [(d, -s) for s, _, d in sorted(found)[:k]]
    return out


def check(spark, docs, queries, k, **more):
    got = defaultdict(list)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for r in sorted(M.search(d, spark.createDataFrame(queries, "query_id long, text string"), k, **more).collect()):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for q, want in brute(docs, queries, k).items():
        assert len(got[q]) == len(want)
        for (a, s), (b, t) in zip(got[q], want):
            assert abs(s - t) < 1e-6
        assert sorted(str(a) for a, s in got[q] if s > want[-1][1] + 1e-6) == sorted(str(b) for b, t in want if t > want[-1][1] + 1e-6)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    queries = [r for r in docs if r[0] % 20 == 0] + [(9001, "idiot the of"), (9002, "nothingofthekind"), (9003, None), (9004, "")]
    check(spark, docs, queries, 10)
    check(spark, docs, queries, 3, most_queries=4, shard_bytes=20_000)


def test_nulls_repeats_and_ties(spark):
    docs = [(3, "a b"), (1, "a b"), (None, "a b"), (2, "A c"), (2, "A c"), (4, None), (5, "")]
    check(spark, docs, [(1, "a"), (2, "a b c"), (3, "c c c")], 3)
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert M.search(none, some).count() == 0
    assert M.search(some.withColumnRenamed("query_id", "doc_id"), some.limit(0)).count() == 0


def test_pruning_keeps_what_blocks_hide(spark):
    import random

    rng = random.Random(4)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    docs = [(i, " ".join(rng.choices(common, k=rng.randint(1, 30)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(900)]
    queries = [(i, docs[i * 7][1]) for i in range(25)] + [(99, "c1 c2"), (98, "r5")]
    check(spark, docs, queries, 5)

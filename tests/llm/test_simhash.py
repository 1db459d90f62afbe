import random

import xxhash
from hypothesis import given, settings, strategies as st

from relcheck.llm import simhash as S
from relcheck.llm.components import connected_components
from relcheck.llm.textscan import text_bytes
import pyarrow as pa
import re


def plain_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(pairs):
    """pairs: (doc_id, fp)"""
    parent = {d: d for d, _ in pairs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, fa) in enumerate(pairs):
        for b, fb in pairs[:i]:
            if (fa ^ fb).bit_count() <= 3:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d, _ in pairs}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="AbÉ \n\x0b\x1f z", max_size=40)), max_size=10))
def test_fingerprints(texts):
    got = S.fingerprints_of(*text_bytes(pa.array(texts, pa.string())))
    assert got.tolist() == [plain_fp(t) for t in texts]


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(30)}
    values |= {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in list(values)}
    tree = S.BKTree()
    for v in values:
        tree.add(v)
        tree.add(v)
    for v in values:
        assert sorted(tree.near(v, 3)) == sorted(u for u in values if (u ^ v).bit_count() <= 3)


def test_links_join_what_brute_force_joins(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = set(centres)
    for c in centres[:6]:
        for _ in range(40):  # walks away from its centre in small steps
            c ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4)))
            c &= (1 << 64) - 1
            fps.add(c)
    low = {(7 << 40) | (rng.getrandbits(10) << rng.randrange(0, 30)) for _ in range(150)}  # crowds most blocks
    fps = sorted(fps | low)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(list(zip(range(len(fps)), fps)))
    for limit in (400, 8):
        links = S.fingerprint_links(nodes, 3, shard_limit=limit)
        got = {r["node"]: r["component"] for r in connected_components(links).collect()}
        groups = {}
        for i, x in enumerate(signed):
            groups.setdefault(got.get(x, x), set()).add(i)
        wanted = {}
        for i, root in want.items():
            wanted.setdefault(root, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicates_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9004, "one"), (9005, "ONE")]
    both = spark.createDataFrame(rows, "doc_id long, text string")
    fps = {d: plain_fp(t) for d, t in rows}
    want = plain_components(sorted(set(fps.items())))
    got = S.near_duplicates(both).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == format(fps[r["doc_id"]], "016x")
        assert r["component_id"] == want[r["doc_id"]]


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "zz")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (None, 5), (None, None)]
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(1, 70)] + [(200, 200 + i) for i in range(1, 60)] + [(500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 71)}, **{200 + i: 200 for i in range(60)}}

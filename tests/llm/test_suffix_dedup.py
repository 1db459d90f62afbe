import random
import re
from collections import defaultdict

import numpy as np

from relcheck.llm import suffix_dedup as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, length):
    """Words of each distinct (doc, text) in repeated windows, kept and removable."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    places = defaultdict(list)
    for r in rows:
        w = split(r[1])
        for s in range(len(w) - length + 1):
            places[tuple(w[s : s + length])].append((r, s))
    removable, kept = defaultdict(set), defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            (r0, s0), *rest = found
            kept[r0] |= set(range(s0, s0 + length))
            for r, s in rest:
                removable[r] |= set(range(max(s, s0 + length) if r == r0 else s, s + length))
    return removable, kept


def check(spark, rows, length, k):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removable, kept = brute(rows, length)
    got = {True: defaultdict(set), False: defaultdict(set)}
    for r in S.repeated_spans(docs, length, k).collect():
        assert r["n_words"] == r["end_word"] - r["first_word"]
        got[r["removable"]][r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
    assert {a: b for a, b in got[True].items() if b} == {r[0]: x for r, x in removable.items() if x}
    assert got[False] == {r[0]: x for r, x in kept.items()}
    clean = defaultdict(list)
    for r in S.without_repeats(docs, length, k).collect():
        clean[r["doc_id"]].append(r["text"])
    for r in set(rows):
        w = [x for i, x in enumerate(split(r[1])) if i not in removable.get(r, ())]
        if r in removable and not w:
            assert r[0] not in clean
        else:
            assert all(split(t) == w for t in clean[r[0]])
            if r not in removable:
                assert r[1] in clean[r[0]]
    return got


def test_planted_passages(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, other = text(15), text(12)
    rows = [(1, text(40)), (2, text(8) + " " + passage + ". " + text(9)), (3, passage.upper()), (4, text(5) + "\n" + passage + " " + other), (5, other + " " + text(3)), (6, passage + ", " + other), (7, None), (8, "")]
    rows += [(9, text(30)), (10, rows[0][1]), (10, rows[0][1]), (11, "la " * 60), (12, "a b c " * 20), (13, passage[:40])]
    got = check(spark, rows, 10, 3)
    assert set(got[True]) >= {3, 4, 6, 10, 11, 12} and not set(got[True]) & {1, 9, 13}


def test_small_vocabulary_everywhere(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    check(spark, rows, 7, 2)


def test_real_texts(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, 50, 8)


def test_nulls_and_empty(spark):
    t = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(None, t), (4, t), (2, t + " more")], "doc_id long, text string")
    got = {(r["doc_id"], r["removable"]) for r in S.repeated_spans(docs, 10, 3).collect()}
    assert got == {(None, False), (2, True), (4, True)}
    assert S.repeated_spans(docs.limit(0), 10, 3).count() == 0
    assert S.without_repeats(docs.limit(0), 10, 3).count() == 0


def test_each_hash_of_a_window_tells_its_words():
    rng = np.random.default_rng(8)
    hashes = S.mix(rng.integers(0, 3, 4000).astype(np.uint64))
    begin = np.arange(len(hashes) - 6)
    words_of = np.unique(np.lib.stride_tricks.sliding_window_view(hashes, 7), axis=0, return_inverse=True)[1].ravel()
    for codes in (hashes, S.mix(hashes ^ S.SECOND)):
        h = np.unique(S.span_hashes(codes, begin, begin + 7), return_inverse=True)[1].ravel()
        assert len(set(zip(h.tolist(), words_of.tolist(), strict=True))) == len(set(words_of.tolist())) == len(set(h.tolist()))


def test_columns_that_clash(spark):
    t = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(None, t, 1, 2, "a", 3, 4), (4, t + " z", 5, 6, "b", 7, 8)], "doc_id long, text string, row int, cuts int, of string, `its row` int, first_word int")
    got = S.without_repeats(docs, 10, 3).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is None) == [(None, t, 1, 2, "a", 3, 4)]
    assert [tuple(r) for r in got if r["doc_id"] == 4] == [(4, "z", 5, 6, "b", 7, 8)]

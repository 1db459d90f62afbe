import random

import corpus_pipeline
from relcheck.llm import similar


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    sets, parent = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def near_copies():
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    licence = " ".join(f"l{i}" for i in range(30))
    rows += [(100 + i, licence + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(25))) for i in range(30)]
    return rows + [(200, "one two"), (201, "ONE  two"), (202, "one two three"), (203, None), (204, " ")]


def test_components_match_brute_force(spark):
    rows = near_copies()
    want = components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit, rounds in ((16, 12), (2, 2), (2, 12)):
        got = {r[0]: r[1] for r in similar.near_duplicates(docs, pair_limit=limit, rounds=rounds).collect()}
        assert got == want


def test_stage_keeps_one_of_texts_at_four_fifths(spark, sf):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()}
    assert got == {d for d, c in components(rows).items() if d == c}


def test_null_ids_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "zz")], "doc_id long, text string")
    got = sorted(((r[0], r[1]) for r in similar.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (5, 5), (None, 5), (None, None)]
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_sets_of_many_sizes_match_brute_force(spark):
    """Prefixes, extensions and cuts of common texts: partners differ in size up to the limit, by one shingle more and less."""
    rng = random.Random(11)
    rows = []
    for group in range(4):
        base = [f"g{group}w{i}" for i in range(140)]
        for n in (*range(20, 140, 3), 104, 105, 129, 130):
            at = rng.randrange(0, 140 - n + 1) if rng.random() < 0.4 else 0
            own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 0, 2, n // 10, n // 5]))]
            rows.append((len(rows), " ".join(base[at : at + n] + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    assert 4 < len(set(want.values())) < len(rows) - 20
    got = {r[0]: r[1] for r in similar.near_duplicates(docs, pair_limit=2, rounds=1).collect()}
    assert got == want


def test_common_text_without_partners_meets_nobody(spark):
    """Sets that share four fifths of their text but are not similar have no group to be paired in."""
    licence = " ".join(f"l{i}" for i in range(84))
    rows = [(h, n, pos) for h in (1, 2) for n, pos in ((100, 20), (100, 16), (101, 18), (90, 12))] + [(3, 100, 11), (3, 100, 5), (4, 100, 20), (4, 80, 0)]
    bands = similar._bands(spark.createDataFrame(rows, "h long, n long, pos long"), 0.8)
    held = {r["h"] for r in bands.groupBy("h", "band").agg({"smaller": "max"}).where("`max(smaller)`").collect()}
    assert held == {3, 4}
    texts = [(i, f"{licence} " + " ".join(f"u{i}x{j}" for j in range(16))) for i in range(20)]
    got = {r[0]: r[1] for r in similar.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(20)} == components(texts)

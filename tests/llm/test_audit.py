import random
import re
from itertools import permutations

import numpy as np

from relcheck.llm import audit as M

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def failing(docs):
    """The names of the failed filters of each row, straight from the definitions."""
    out = []
    for d, t, _ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 100:
            f.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs):
            f.add("E")
        out.append(f)
    return out


def brute(docs, labels):
    fails = failing(docs)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    out = {}
    for part in {lang or "" for *_, lang in docs}:
        rows = [(d, f) for (d, _, lang), f in zip(docs, fails) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                all_failing = sum(name in f for _, f in rows)
                out[part, "".join(order), step] = [len(left), len(gone), all_failing - len(gone), sum(f == {name} for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return out


def check(spark, docs, labels):
    rows = M.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in rows}
    assert len(got) == len(rows) and got == brute(docs, labels)


def test_random_documents(spark):
    rng = random.Random(12)
    docs = []
    for i in range(150):
        words = [rng.choice(["a", "B", "cc", "D$", "e f", "É", "\U0001F600"]) if rng.random() < 0.5 else f"w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 99, 100, 101, 150]))]
        docs.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words), rng.choice(["de", "en", None, ""])))
    docs += [(200 + i, docs[rng.randint(0, 149)][1], "fr") for i in range(40)]
    check(spark, docs, [(rng.randint(0, 240), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(120)])


def test_nulls_repeats_ties_and_empty_tables(spark):
    long = "Wort " * 30_000 + "x" * 100_000
    docs = [(5, None, "en"), (6, "", "en"), (6, "", "en"), (4, "   ", None), (None, "", "en"), (None, None, ""), (7, long, "de"), (9, long, "de"), (9, long, "fr"), (-1, "A&B", "en"), (3, "A&B", "en")]
    check(spark, docs, [(6, 1, None), (6, None, 1), (9, 0, 1), (9, 1, 0), (None, 1, 1), (77, 1, 1)])
    check(spark, docs, [])
    assert M.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_other_filters_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "en", True, "p"), (2, "a", "en", None, "q"), (3, "b", "en", False, "q")], "doc_id long, text string, lang string, mask boolean, part string")
    labels = spark.createDataFrame([(1, 1, 0, "x")], LABELS + ", part string")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in M.audit(docs, labels, {"M": F.col("mask")}).collect()}
    assert got == {("ME", 1): (2, 1, 0, 1, 1, 0, 2), ("ME", 2): (1, 1, 0, 1, 0, 0, 2), ("EM", 1): (2, 1, 0, 1, 0, 0, 2), ("EM", 2): (1, 1, 0, 1, 1, 0, 2)}


def test_removal_steps_are_first_failing_positions():
    orders = np.array(list(permutations(range(4))))
    steps = M.removal_steps(np.arange(16), orders)
    for m in range(16):
        for o, order in enumerate(orders):
            failing = [s for s, f in enumerate(order) if m >> f & 1]
            assert steps[m, o] == failing[0] if failing else steps[m, o] >= M.NEVER

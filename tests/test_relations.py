import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from relcheck.operators import relations as R
from relcheck.operators.keyed import keyed_diff
from relcheck.operators.scans import dealt, running

ROW = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["a", "b", ""]))
quick = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows, names="k int, s string"):
    return spark.createDataFrame(rows, names)


def one(df):
    (row,) = df.collect()
    return row


@quick
@given(have=st.lists(ROW, max_size=8), want=st.lists(ROW, max_size=8))
def test_counts_follow_the_definitions(spark, have, want):
    a, b = frame(spark, have), frame(spark, want, "x int, y string")
    r = one(R.set_eq(a, b))
    assert (r["missing_count"], r["extra_count"]) == (len(set(want) - set(have)), len(set(have) - set(want)))
    r = one(R.bag_eq(a, b, samples=False))
    kinds = set(have) | set(want)
    missing = sum(max(want.count(x) - have.count(x), 0) for x in kinds)
    extra = sum(max(have.count(x) - want.count(x), 0) for x in kinds)
    assert (r["missing_count"], r["extra_count"], r["passed"]) == (missing, extra, sorted(map(str, have)) == sorted(map(str, want)))
    assert one(R.set_ne(a, b))["passed"] == (set(have) != set(want))
    assert one(R.bag_has(a, b, samples=False))["passed"] == (missing == 0)


def test_labels_do_not_matter_and_samples_are_bounded(spark):
    have = frame(spark, [(1, "paid"), (2, "pending")])
    want = frame(spark, [(1, "paid"), (2, "shipped")], "a int, b string")
    r = one(R.set_eq(have, want, "orders"))
    assert (r["missing_count"], r["extra_count"], r["truncated"], r["description"]) == (1, 1, False, "orders")
    assert r["missing_sample"] == ['["2","shipped"]'] and r["extra_sample"] == ['["2","pending"]']
    many = one(R.set_has(frame(spark, []), frame(spark, [(i, None) for i in range(30)])))
    assert many["missing_count"] == 30 and len(many["missing_sample"]) == 20 and many["truncated"] and many["extra_count"] == 0


def test_shapes_are_results_not_errors(spark):
    a, b, c = frame(spark, [(1, "x")]), spark.createDataFrame([(1,)], "k int"), frame(spark, [("1", "x")], "k string, s string")
    for f in (R.set_eq, R.bag_eq, R.set_has, R.bag_has):
        assert not one(f(a, b))["passed"] and not one(f(a, c))["passed"]
    assert one(R.set_ne(a, b))["passed"] and one(R.set_ne(a, c))["passed"]
    assert not one(R.results_eq(a, c, ["k"]))["comparable"]
    assert one(R.comparable(a, frame(spark, [], "k bigint, s string")))["passed"]


@pytest.mark.parametrize("partitions", [1, 5])
def test_positions_and_ordered_results(spark, partitions):
    rows = [(i % 7, f"s{i}") for i in range(40)] + [(None, "n")]
    df = frame(spark, rows).repartition(partitions)
    got = sorted((r["position"], r["k"], r["s"]) for r in R.with_position(df, ["k"]).collect())
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(k, s) for _, k, s in got] == want and [p for p, *_ in got] == list(range(1, 42))
    same = one(R.results_eq(df, frame(spark, rows, "a int, b string"), ["k"]))
    assert same["passed"] and same["first_difference_at"] is None
    changed = one(R.results_eq(df, frame(spark, [(0, "zzz") if r == want[3] else r for r in rows]), ["k"]))
    assert not changed["passed"] and changed["first_difference_at"] == 4
    shorter = one(R.results_eq(df, frame(spark, want[:-2]), ["k"]))
    assert (shorter["have_rows"], shorter["want_rows"], shorter["first_difference_at"]) == (41, 39, 40)


def test_emptiness_and_keys(spark):
    empty = frame(spark, [])
    assert one(R.is_empty(empty))["passed"] and not one(R.isnt_empty(empty))["passed"]
    assert one(R.is_empty(frame(spark, [(1, "a")])))["sample"] == ['["1","a"]']
    have = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (4, None, 4)], "k int, s string, n int")
    want = spark.createDataFrame([(1, "a", 1), (2, "x", None), (3, "c", 3), (4, None, 4)], "k int, s string, n int")
    got = {r["k"]: (r["status"], r["changed_columns"]) for r in keyed_diff(have, want, ["k"]).collect()}
    assert got == {2: ("changed", ["s", "n"]), 3: ("missing", [])}


def paired(have, want):
    """Differences of bags of (k, s, n) by k, copy by copy."""
    out = Counter()
    low = lambda r: [(x is not None, x) for x in r[1:]]
    for k in {r[0] for r in [*have, *want]}:
        h, w = (Counter(r for r in rows if r[0] == k) for rows in (have, want))
        h, w = sorted((h - w).elements(), key=low), sorted((w - h).elements(), key=low)
        for a, b in zip(h, w):
            out[k, "changed", tuple(c for c, x, y in zip("ksn", a, b) if x != y)] += 1
        if len(h) != len(w):
            out[k, "extra" if len(h) > len(w) else "missing", ()] += abs(len(h) - len(w))
    return out


@pytest.mark.parametrize("most_rows", [1_000, 9])
def test_keyed_differences_of_bags(spark, most_rows):
    rng = random.Random(most_rows)
    names = "k int, s string, n int"
    for size in (0, 90):
        have = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for _ in range(size)]
        want = have[: size // 2] + [(rng.choice([None, 1, 1, 4]), rng.choice(["a", "c"]), rng.choice([1, None])) for _ in range(size // 2)]
        rng.shuffle(want)
        got = [(r["k"], r["status"], tuple(r["changed_columns"]), r["copies"]) for r in keyed_diff(spark.createDataFrame(have, names).repartition(4), spark.createDataFrame(want, names), ["k"], most_rows).collect()]
        assert Counter({x[:3]: x[3] for x in got}) == paired(have, want) and len(got) == len({x[:3] for x in got})
        assert keyed_diff(*[spark.createDataFrame(have, names)] * 2, ["k"], most_rows).count() == 0


def test_many_copies_of_one_key_are_counted_not_joined(spark):
    have = spark.range(300_000).selectExpr("1 AS k", "CAST(id % 3 AS INT) AS v", "'h' AS wanted")
    want = spark.range(400_000).selectExpr("1 AS k", "CAST(id % 4 AS INT) AS v", "'h' AS wanted")
    got = {(r["status"], tuple(r["changed_columns"])): r["copies"] for r in keyed_diff(have, want, ["k"]).collect()}
    assert got == {("missing", ()): 100_000}
    other = want.withColumn("wanted", F.lit("w"))
    got = {(r["status"], tuple(r["changed_columns"])): r["copies"] for r in keyed_diff(have, other, ["k"]).collect()}
    assert got == {("missing", ()): 100_000, ("changed", ("wanted",)): 100_000 * 3}
    only_keys = have.select("k", "v")
    assert [tuple(r) for r in keyed_diff(only_keys, only_keys.limit(0), ["k", "v"]).orderBy("v").collect()] == [(1, v, "extra", [], 100_000) for v in range(3)]


KINDS = {"sum": lambda v, i: sum(x or 0 for x in v[: i + 1]), "last": lambda v, i: next((x for x in reversed(v[: i + 1]) if x is not None), None), "reach": lambda v, i: max((x for x in v[:i] if x is not None), default=None), "before": lambda v, i: v[i - 1] if i else None, "next": lambda v, i: v[i + 1] if i + 1 < len(v) else None}


@pytest.mark.parametrize("most_rows", [10_000, 20])
def test_running_values_do_not_depend_on_how_a_key_is_dealt(spark, most_rows):
    rng = random.Random(7)
    rows = [(k, "x", i, rng.choice([None, *range(-5, 9)])) for k, n in ((1, 90), (None, 40), (3, 1), (4, 7)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k int, l string, i int, v int").repartition(5)
    out = running(dealt(df, ["k", "l"], ["i"], most_rows), ["k", "l"], ["i"], **{kind: (kind, F.col("v")) for kind in KINDS})
    again = running(out, ["k", "l"], ["i"], twice=("sum", F.col("sum")))
    got = {(r["k"], r["i"]): r for r in again.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        values = [r[3] for r in rows if r[0] == key]
        for i in range(len(values)):
            r = got[key, i]
            assert {k: r[k] for k in KINDS} == {k: f(values, i) for k, f in KINDS.items()}, (key, i)
            assert r["twice"] == sum(KINDS["sum"](values, j) for j in range(i + 1))


def test_one_key_is_dealt_over_all_tasks(spark):
    df = spark.range(40_000).selectExpr("1 AS k", "id AS i")
    out = dealt(df, ["k"], ["i"], 1000)
    sizes = [r["count"] for r in out.groupBy(out.columns[-1]).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 3_000
    assert running(out, ["k"], ["i"], s=("sum", F.lit(1))).where("s <> i + 1").count() == 0


def test_relation_of(spark):
    assert {r["value"] for r in R.relation_of(spark, [3, 1, 3]).collect()} == {1, 3}
    assert R.relation_of(spark, []).count() == 0


def test_signed_aggregate_is_one_shuffle(spark):
    df = frame(spark, [(1, "a")] * 3)
    plan = R.bag_eq(df, df.where("k > 0"), samples=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

import hashlib

import pytest
from pyspark.sql import functions as F

from relcheck.functions import scalars as X
from relcheck.operators import catalog as G, constraints as K, failures as L, reports as J, rows as P

C = F.col


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(C("v")).alias("o")).orderBy("i").collect()]


def test_durations(spark):
    texts = ["5s", "500ms", "2min", "1h", "7", " 3 hours ", "", None, "-1s", "5 d", "99999999999999999h", "1.5s", "0"]
    assert column(spark, texts, X.parse_duration_ms) == [5000, 500, 120000, 3600000, 7, 10800000, None, None, None, None, None, None, 0]
    ms = [0, 1, 999, 1000, 1500, 60000, 90000, 3600000, 5400000]
    assert column(spark, ms, X.format_duration, "long") == ["0", "1ms", "999ms", "1s", "1500ms", "1min", "90s", "1h", "90min"]
    assert column(spark, ms, X.parse_duration_ms and (lambda c: X.parse_duration_ms(X.format_duration(c))), "long") == ms
    assert column(spark, [12, 1500, 123000], X.human_duration, "long") == ["12ms", "1.5s", "2m3s"]


def test_names(spark):
    assert column(spark, ["Add Orders!", "--a--b--", "é", None, "x" * 90, "a" * 79 + "-b"], X.normalize_slug) == ["add-orders", "a-b", None, None, "x" * 80, "a" * 79]
    u = "018f2b6c-1111-7abc-8def-0123456789ab"
    got = column(spark, [u + "-add-x", u, "add-x", u + "x"], X.split_package_name)
    assert [(r["id"], r["slug"]) for r in got] == [(u, "add-x"), (u, ""), (None, ""), (u, "x")] and got[0]["short_id"] == u[:8]
    assert column(spark, [u, "x", None], X.uuid_version) == [7, None, None]
    assert column(spark, ['a"b', ""], X.quote_identifier) == ['"a""b"', '""']


def test_stable_key_and_hash(spark):
    import hashlib

    values = ["", "a", "é"]
    assert column(spark, values, X.stable_key) == [int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "big", signed=True) for v in values]
    assert column(spark, values, X.sha256_hex) == [hashlib.sha256(v.encode()).hexdigest() for v in values]


def test_globs(spark):
    cases = [("*.sql", "a.sql", 1), ("*.sql", "d/a.sql", 0), ("**/a.sql", "a.sql", 1), ("**/a.sql", "x/y/a.sql", 1), ("x/**", "x/y/z", 1), ("x/**", "xx/y", 0), ("a?c", "abc", 1), ("a?c", "a/c", 0), ("[ab].x", "b.x", 1), ("[!ab].x", "b.x", 0), ("a.b*", "aXb", 0), ("plain", "plain", 0)]
    df = spark.createDataFrame(cases, "g string, p string, want int")
    for r in df.select("g", "p", "want", F.coalesce(F.regexp_like("p", X.glob_to_regex(C("g"))), F.lit(False)).alias("got")).collect():
        assert r["got"] == bool(r["want"]), r


def test_line_and_column(spark):
    df = spark.createDataFrame([("ab\ncd\n", i) for i in range(7)], "t string, o int")
    assert [tuple(r["p"]) for r in df.select(X.line_and_column(C("t"), C("o")).alias("p"), "o").orderBy("o").collect()] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1)]


def test_null_rules_differ_by_family(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, None), (3, 5)], "k int, v int")
    assert P.ok(df, C("v") > 0).first()["failures"] == 2
    assert K.validate_check(df, C("v") > 0).first()["failures"] == 0
    assert P.is_equal(df, C("v"), C("v")).first()["passed"] and not P.matches(df, C("v"), ".").first()["passed"] and not P.doesnt_match(df, C("v"), "x").first()["passed"]
    assert K.validate_unique(df, ["v"]).first()["passed"] and not K.col_is_pk(df, ["v"]).first()["passed"] and not K.col_is_pk(df, ["k"]).first()["passed"]
    with pytest.raises(ValueError):
        P.cmp_ok(df, C("k"), "~", C("v"))


def test_failure_kinds(spark):
    df = spark.createDataFrame([("12", 1)], "s string, n int")
    assert K.col_not_null(df, ["nope"]).first()["failure_kind"] == "missing_object"
    assert K.col_type_is(df, "s", "no such type").first()["failure_kind"] == "invalid_expected"
    assert K.col_type_is(df, "s", "varchar(1)").first()["failure_kind"] == "column_property"
    assert K.col_type_is(df, "s", "integer").first()["passed"] and K.col_type_is(df, "s", "character varying(12)").first()["passed"]
    assert K.col_default_is(df, "n", "x").first()["failure_kind"] == "invalid_expected" and K.col_default_is(df, "n", 1).first()["passed"]


def test_describe_keeps_null_and_empty_apart(spark):
    got = [tuple(x) for x in column(spark, [None, "", 'q"'], lambda c: P.describe(c, "text"))]
    assert got == [("null", None, "text", True), ('""', "", "text", False), ('"q\\""', 'q"', "text", False)]


def test_labels_in_order(spark):
    df = spark.createDataFrame([("sad", 1), ("ok", 2), ("happy", 3), (None, 4)], "l string, o int")
    assert K.accepted_values(df, "l", ["sad", "ok", "happy"], "o").first()["passed"]
    assert not K.accepted_values(df, "l", ["ok", "sad", "happy"], "o").first()["passed"]
    assert K.accepted_values(df, "l", ["ok", "sad", "happy"]).first()["passed"]


def test_failures_and_timings(spark):
    df = spark.createDataFrame([(1, "22012", "division by zero"), (2, None, None), (3, "23505", "duplicate key")], "k int, sqlstate string, message string")
    passed = lambda f: [r["passed"] for r in f.orderBy("k").collect()]
    assert passed(L.throws_ok(df)) == [True, False, True] and passed(L.throws_ok(df, "22012", "other")) == [False] * 3
    assert passed(L.throws_sqlstate(df, "23505")) == [False, False, True] and passed(L.throws_ilike(df, "DIV%")) == [True, False, False]
    for bad in (("nope", None), ("22012", "ABCDE")):
        with pytest.raises(ValueError):
            L.throws_sqlstate(df, *bad)
    t = spark.createDataFrame([("a", i, float(i)) for i in range(20)], "g string, i int, ms double")
    assert not L.performs_ok(t, "ms", 19.0, ["g"]).first()["passed"] and L.performs_ok(t, "ms", 19.5, ["g"]).first()["passed"]
    r = L.performs_within(t, "ms", 4.5, 0.0, ["g"], ["i"]).first()
    assert r["passed"] and r["iterations"] == 10
    assert L.performs_within(t, "ms", 0.0, 0.0, ["g"], ["i"], iterations=0).first()["iterations"] == 1


def test_policy_allow_beats_deny(spark):
    f = spark.createDataFrame([(1, 1, "a", "m", "h"), (2, 1, "a", "m", "h"), (2, 2, "b", "m", "h")], "package_id int, ordinal int, code string, message string, hint string")
    allow = spark.createDataFrame([(1, 2, "a", "second"), (1, 1, "a", "first")], "package_id int, place int, code string, reason string")
    deny = spark.createDataFrame([("a",), ("a",)], "code string")
    got = {(r["package_id"], r["code"]): (r["severity"], r["message"], r["hint"]) for r in J.apply_policy(f, allow, deny).collect()}
    assert got == {(1, "a"): ("note", "m (accepted: first)", None), (2, "a"): ("error", "m", "h"), (2, "b"): ("warning", "m", "h")}
    assert column(spark, [None, "graph.cycle", "deploy.failed", "who knows"], J.exit_code_of) == [0, 4, 9, 70]


def test_reports_are_compared_field_by_field(spark):
    from relcheck.sources import logs as S

    def parsed(*documents):
        return S.parse_reports(spark.createDataFrame([(d,) for d in documents], "value string"))[0]

    one = '{"report_version":1,"run":{"id":"%s","started_at":"%s"},"outcome":"%s","migrations":[{"id":"%s","slug":"s","status":"%s","duration_ms":%d}],"tests":[{"path":"p","assertions":[{"number":1,"diagnostics":{"have":"%s"}}]}]}'
    a = parsed(one % ("r1", "x", "success", "i1", "ok", 5, "1"), one % ("r2", "x", "failure", "i1", "ok", 5, "1"), one % ("r2", "x", "failure", "i1", "ok", 5, "1"), '{"report_version":1,"run":{"id":"gone"}}')
    b = parsed(one % ("r1", "later", "success", "i2", "bad", 9, "2"), one % ("r2", "x", "failure", "i1", "ok", 5, "1"), one % ("r2", "x", "success", "i1", "ok", 5, "1"))
    got = {(r["run_id"], r["path"]): (r["was"], r["now"]) for r in J.diff_fields(a, b).collect()}
    assert got == {
        ("r1", "migrations[0].status"): (["ok"], ["bad"]), ("r1", "tests[0].assertions[0].diagnostics.have"): (["1"], ["2"]), ("r2", "outcome"): (["failure"], ["success"]),
        ("gone", "report_version"): (["1"], []), ("gone", "run.id"): (["[id]"], []), ("gone", "run.started_at"): (["[started_at]"], []), ("gone", "run.finished_at"): (["[finished_at]"], []), ("gone", "run.duration_ms"): (["0"], []),
    }
    assert J.diff_fields(a, a).count() == 0


def test_privileges_are_inherited(spark):
    grants = spark.createDataFrame([("t", "a", "SELECT"), ("t", "PUBLIC", "INSERT"), ("t", "a", "NONSENSE")], "object string, grantee string, privilege string")
    members = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "c")], "role string, member_of string")
    got = {r["role"]: r["privileges"] for r in G.effective_privileges(grants, members).collect()}
    assert got == {x: ["INSERT", "SELECT"] for x in "abc"} | {"PUBLIC": ["INSERT"]}
    asked = spark.createDataFrame([("t", "stranger"), ("t", "b"), ("u", "b"), ("t", "b")], "object string, role string")
    found = G.effective_privileges(grants, members, asked=asked)
    assert {(r["object"], r["role"]): r["privileges"] for r in found.collect()} == {("t", x): ["INSERT", "SELECT"] for x in "abc"} | {("t", x): ["INSERT"] for x in ("PUBLIC", "stranger")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r["role"] for r in G.roles_with_any(members, ["a"]).collect()} == {"a", "b", "c"}


def test_public_privileges_are_spelled_out_for_every_role(spark):
    rows = [("t", "a", "SELECT"), ("u", "PUBLIC", "INSERT"), ("u", "PUBLIC", "MAINTAIN"), ("u", "a", "DELETE"), ("v", "PUBLIC", "SELECT"), ("v", "d", "NONSENSE")]
    grants = spark.createDataFrame(rows, "object string, grantee string, privilege string")
    members = spark.createDataFrame([("c", "b"), ("b", "a"), ("e", "f")], "role string, member_of string")
    want = {("t", x): ["SELECT"] for x in "abc"} | {("v", x): ["SELECT"] for x in [*"abcdef", "PUBLIC"]}
    want |= {("u", x): ["DELETE", "INSERT", "MAINTAIN"] for x in "abc"} | {("u", x): ["INSERT", "MAINTAIN"] for x in [*"def", "PUBLIC"]}
    got = [((r["object"], r["role"]), r["privileges"]) for r in G.effective_privileges(grants, members).collect()]
    assert sorted(got) == sorted(want.items())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        unsent = G.effective_privileges(grants, members, broadcast_roles=2)
        assert "CartesianProduct" in unsent._jdf.queryExecution().executedPlan().toString()
        assert sorted(((r["object"], r["role"]), r["privileges"]) for r in unsent.collect()) == sorted(want.items())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def held_by_all(spark, sf):
    """(object, role) to privileges, and direct grants, of the derived tables by brute force."""
    from relcheck.plans.fixtures import table

    grants = [tuple(r) for r in table(spark, sf, "grants").select("object", "grantee", "privilege").collect()]
    above = {}
    for r in table(spark, sf, "memberships").collect():
        above.setdefault(r["role"], set()).add(r["member_of"])
        above.setdefault(r["member_of"], set())
    for _ in above:
        above = {x: up.union(*(above[y] for y in up)) for x, up in above.items()}
    held, direct = {}, {}
    for role in {*above, "PUBLIC", *(g[1] for g in grants)}:
        for obj, grantee, privilege in grants:
            if grantee in {role, "PUBLIC", *above.get(role, ())}:
                held.setdefault((obj, role), set()).add(privilege)
            if grantee == role != "PUBLIC":
                direct.setdefault((obj, role), set()).add(privilege)
    return held, direct


def test_query_of_effective_privileges_names_every_role(spark, sf):
    import __spark_entry__ as entry

    held, _ = held_by_all(spark, sf)
    got = [((r["object"], r["role"]), r["privileges"]) for r in entry.queries()["g6_effective_privileges"](spark, sf).collect()]
    assert sorted(got) == sorted((k, ",".join(sorted(v))) for k, v in held.items())


def test_query_of_privilege_comparison_names_every_role(spark, sf):
    import __spark_entry__ as entry

    held, direct = held_by_all(spark, sf)
    want = [(k, held[k] == direct.get(k, set()), "", ",".join(sorted(held[k] - direct.get(k, set())))) for k in held]
    got = [((r["object"], r["role"]), r["passed"], r["missing"], r["unexpected"]) for r in entry.queries()["g7_privs_are"](spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_samples_of_failing_rows_are_bounded_and_stable(spark):
    from relcheck.operators import rows as P

    rows = [(i, "hot" if i % 10 else "cold", None if i % 7 == 0 else i) for i in range(500)] + [(1000, "fine", 1), (3, None, -1)]
    have = [spark.createDataFrame(rows, "id int, g string, v int").repartition(n) for n in (1, 6)]
    found = [{r["g"]: r for r in P.cmp_ok(df, df["v"], "<", F.lit(1).cast("int"), ["g"], 5, ["id"]).collect()} for df in have]
    for by_group in found:
        assert {g: (r["rows"], r["failures"], len(r["sample"])) for g, r in by_group.items()} == {"hot": (450, 450, 5), "cold": (50, 49 if rows[0][2] == 0 else 50, 5), "fine": (1, 1, 1), None: (1, 0, 0)}
        want = sorted((r for r in rows if r[1] == "hot"), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())[:5]
        assert [x["have"]["display"] for x in by_group["hot"]["sample"]] == [None if r[2] is None else str(r[2]) for r in want]
        assert by_group["fine"]["sample"][0]["have"].asDict() == {"json": "1", "display": "1", "type": "int", "is_null": False} and by_group["fine"]["sample"][0]["operator"]["display"] == "<"
    assert found[0] == found[1]
    df = have[1]
    (one,) = P.ok(df, df["v"] >= 0, evidence=3).collect()
    assert one["failures"] == 73 and len(one["sample"]) == 3
    assert P.ok(df.limit(0), df["v"] >= 0, evidence=3).collect()[0]["sample"] == []
    plan = P.ok(df, df["v"] >= 0, ["g"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan

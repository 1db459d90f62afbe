import random

import pytest
from pyspark.sql import functions as F

from relcheck.operators import assertlog as A, history as I
from relcheck.sources import commits as M, logs as S
from relcheck.streaming import streams as T


def log(spark, *events):
    return spark.createDataFrame([(1, i + 1, *e) for i, e in enumerate(events)], "file_id int, seq int, op string, passed boolean, n int, text string")


def test_todo_skip_and_notes(spark):
    ok, bad = ("assert", True, None, None), ("assert", False, None, None)
    df = log(spark, ("note", None, None, "early"), bad, ("todo", None, 0, None), bad, bad, ("todo_start", None, None, "why"), bad, ("skip", None, 3, "s"), bad, ("todo_end", None, None, None), bad, ("todo", None, None, "rest"), ok, ok, ("note", None, None, "late"), ("skip", None, -1, "none"))
    got = [(r["number"], r["directive"], r["directive_reason"]) for r in A.assertions(df).orderBy("number").collect()]
    assert got == [(1, None, None), (2, "todo", ""), (3, None, None), (4, "todo", "why"), (5, "skip", "s"), (6, "skip", "s"), (7, "skip", "s"), (8, "todo", "why"), (9, None, None), (10, "todo", "rest"), (11, "todo", "rest")]
    notes = {r["message"]: r["after_assertion"] for r in A.attach_notes(df).collect()}
    assert notes == {"early": None, "late": 11}
    status = {r["number"]: r["status"] for r in A.assertion_status(A.assertions(df)).collect()}
    assert (status[1], status[2], status[5], status[10]) == ("failed", "todo_failed", "skipped", "todo_passed")


def test_documents_and_outcomes(spark):
    results = spark.createDataFrame([(1, 1, True, None), (1, 3, True, None), (2, 1, False, "todo"), (3, 1, None, None)], "file_id int, number long, passed boolean, directive string")
    plans = spark.createDataFrame([(1, 2), (2, 5), (3, None), (4, 1), (2, 5)], "file_id int, declared long")
    got = {(r["file_id"], r["problem"], r["expected"], r["found"]) for r in A.validate_document(results, plans).collect()}
    assert got == {(1, "lost", 2, 3), (2, "plan_twice", 1, 2), (4, "plan_count", 1, 0)}
    files = spark.createDataFrame([(i,) for i in range(1, 6)], "file_id int")
    errors = spark.createDataFrame([(2,)], "file_id int")
    outcome = {r["file_id"]: (r["results"], r["passed"]) for r in A.file_outcome(files, results, errors).collect()}
    assert outcome == {1: (2, True), 2: (0, False), 3: (1, False), 4: (0, True), 5: (0, True)}


def test_flatten_detail(spark):
    df = spark.createDataFrame([('{"have":{"json":"1","display":"one"},"want":{"display":null},"t":"x","n":2.50,"o":{"a":1},"l":[1,2]}',), (None,)], "d string")
    got = [r["m"] for r in df.select(A.flatten_detail(F.col("d")).alias("m")).collect()]
    assert got == [{"have": "one", "want": "NULL", "t": "x", "n": "2.5", "o": '{"a":1}', "l": "[1,2]"}, None]


def test_selectors(spark):
    paths = spark.createDataFrame([("tests/db/orders/totals.sql",), ("tests/db/orders/status.sql",), ("tests/db/schema.sql",)], "path string")
    pick = lambda *s: sorted(r["path"][9:] for r in A.select_paths(paths, spark.createDataFrame([(x,) for x in s], "selector string")).collect())
    assert pick("db/schema.sql") == ["schema.sql"] and pick("./tests/db/orders/") == ["orders/status.sql", "orders/totals.sql"]
    assert pick("tests/db/*.sql") == ["schema.sql"] and pick("**/*.sql", "db") == ["orders/status.sql", "orders/totals.sql", "schema.sql"]
    assert pick("tests/db/ord") == []
    un = A.unmatched_selectors(paths, spark.createDataFrame([("db",), ("nope",)], "selector string"))
    assert [r["selector"] for r in un.collect()] == ["nope"]


def test_globs_meet_paths_by_a_whole_word(spark):
    rng = random.Random(6)
    parts = ["a", "b.sql", "x_1", "é", "db-2", "10.x", "a.b"]
    paths = {"/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"tests/a/b.sql", "tests/x_1"}
    pieces = ["a", "b", "*", "?", "**/", "/", ".sql", "x_", "1", "[ab]", "[!a]", "é", "-2", "db"]
    globs = {"".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(150)}
    globs = sorted(g for g in globs if set(g) & set("*?["))
    df = spark.createDataFrame([(x,) for x in sorted(paths)], "path string")
    asked = spark.createDataFrame([(g,) for g in globs], "selector string")
    got = {(r["path"], r["selector"]) for r in A._met(df, asked, "tests").collect()}
    s = F.regexp_replace(F.regexp_replace("selector", r"^(\./)+", ""), "/+$", "")
    held = df.crossJoin(asked).withColumn("s", s).withColumn("re", A.glob_to_regex(F.col("s"))).withColumn("within", F.regexp_replace("path", "^tests/", ""))
    assert got == {(r["path"], r["selector"]) for r in held.where(A.is_glob(F.col("s")) & (F.regexp_like("path", F.col("re")) | F.regexp_like("within", F.col("re")))).collect()}


def test_many_globs_need_no_nested_loop(spark):
    paths = spark.range(2000).selectExpr("concat('team', id % 500, '/q', id, '/run.sql') AS path")
    globs = spark.range(100_000).selectExpr("concat('team', id, '/**/*.sql') AS selector")
    found = A.select_paths(paths, globs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 2000
    assert A.unmatched_selectors(paths, globs).count() == 100_000 - 500


def test_history_causes(spark):
    package = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "project int, id long, mode string, deploy_sha256 string, definition_sha256 string")
    edge = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "project int, child long, parent long")
    now = package([(1, "r", "x", "d1"), (2, "r", "x", "d"), (3, "f", "y", "d3"), (4, "r", "x2", "d4"), (5, "r", "x", "d5"), (6, "r", "x", "d")])
    was = package([(1, "r", "x", "d0"), (2, "r", "x", "d"), (3, "r", "x", "d0"), (4, "r", "x", "d0"), (5, "r", "x", "d0"), (6, "r", "x", "d"), (9, "r", "x", "d")])
    got = {r["id"]: r["cause"] for r in I.changed_definitions(now, edge([(2, 1), (2, 3), (1, 5)]), was, edge([(2, 3), (2, 1)])).collect()}
    assert got == {1: "dependencies", 3: "mode", 4: "script", 5: "manifest"}
    assert [(r["id"], r["error"]) for r in I.first_error(now, edge([(1, 5)]), was, edge([])).collect()] == [(9, "missing")]


def test_state_folds_by_time_run_and_sequence(spark):
    rows = [(1, 1, 5, 7, "deploy", "attempted"), (1, 2, 5, 7, "deploy", "failed"), (2, 1, 6, 7, "verify", "succeeded"), (1, 3, 5, 8, "deploy", "succeeded"), (1, 4, 5, 8, "revert", "succeeded"), (3, 1, 9, 9, "deploy", "attempted"), (3, 2, 9, 9, "resolve", "asserted_applied"), (3, 3, 9, 10, "verify", "failed")]
    df = spark.createDataFrame(rows, "run_id long, sequence int, recorded_at int, package_id long, action string, outcome string")
    assert {r["package_id"]: r["state"] for r in I.current_state(df).collect()} == {7: "blocked", 8: "pending", 9: "applied", 10: "pending"}
    assert [(r["package_id"], r["attempts"]) for r in I.unresolved_attempts(df).collect()] == [(7, 1)]


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a" * 64 + "  x y"), (2, ""), (3, "zz  p"), (4, "b" * 64 + "  q"), (5, "C" * 64 + "  q")], "line int, value string")
    sums, problems = S.parse_checksum_lines(lines)
    assert [tuple(r) for r in sums.collect()] == [("x y", "a" * 64)]
    assert sorted((r["line"], r["problem"]) for r in problems.collect()) == [(3, "malformed"), (4, "listed_twice"), (5, "listed_twice")]
    docs = spark.createDataFrame([('{"report_version":1,"later":true,"outcome":"odd"}',), ('{"report_version":2}',), ("no json",)], "value string")
    good, bad = S.parse_reports(docs)
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["malformed", "unknown version 2"]


def test_streams_equal_batches_however_the_log_is_split(spark, sf, tmp_path):
    from relcheck.plans.fixtures import table

    bad = table(spark, sf, "run_log_bad")
    for parts in (1, 4):
        out = T.replay(bad, f"{tmp_path}/d{parts}", lambda s: T.stream_dedup(s, "60 days"), parts, f"{tmp_path}/dc{parts}")
        assert out.count() == bad.select("run_id", "sequence").distinct().count()

    # attempts: out of order within the watermark, in few or many batches, against a plain replay
    rng, rows = random.Random(9), []
    for i in range(400):
        rows.append((rng.choice([1, 2, 3, None]), rng.randint(1, 3), i, rng.choice(["deploy", "resolve", "verify"]), rng.choice(["attempted", "attempted", "succeeded", "asserted_applied", "failed"]), 10 * i + rng.randint(0, 300)))
    rows += [(1, 9, 901, "deploy", "attempted", 9000), (2, 9, 901, "deploy", "succeeded", 9000), (1, 9, 902, "deploy", "attempted", None)]
    log = spark.createDataFrame(rows, "package_id long, run_id long, sequence int, action string, outcome string, s int").selectExpr("* EXCEPT (s)", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) AS recorded_at", "package_id * 1000 + sequence AS file")
    start = 1_704_067_200_000
    kept = sorted((s, run, seq, p, o) for p, run, seq, a, o, s in rows if s is not None and a != "verify" and o != "failed")
    end, timeout, want = kept[-1][0] - 3600, 200, set()
    for package in (1, 2, 3, None):
        opened = None
        mine = [k for k in kept if k[3] == package and k[0] <= end]
        for s, *_, o in [*mine, (end, None, None, None, None)]:
            if opened is not None and s >= opened + timeout:
                want.add((package, "alert", opened + timeout))
            if o == "attempted" and opened is None:
                opened = s
                want.add((package, "opened", s))
            elif o not in ("attempted", None) and opened is not None:
                want.add((package, "retracted" if s >= opened + timeout else "closed", s))
                opened = None
    # a file a batch: by time, or dealt by place in the log, whose times overlap by 300 s
    for parts, order in ((1, "recorded_at"), (3, "sequence")):
        out = T.replay(log, f"{tmp_path}/a{parts}", lambda s: T.stream_attempts(s, timeout * 1000, "1 hour"), parts, f"{tmp_path}/ac{parts}", order_by=order).collect()
        assert len(out) == len(want)
        assert {(r["package_id"], r["change"], (r["at"] - start) // 1000) for r in out} == want


def test_gaps_of_rows_in_any_order_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    seen = {run: sorted(rng.sample(range(1, 60), 35)) for run in (1, 2, 3)}
    rows = [(run, s, rng.randint(0, 1000)) for run, found in seen.items() for s in found]
    rows += rng.sample(rows, 20) + [(1, 0, 5), (1, None, 5)]
    events = spark.createDataFrame(rows, "run_id long, sequence long, s int").selectExpr("run_id", "sequence", "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) AS recorded_at", "s")
    want = {(run, a + 1, b) for run, found in seen.items() for a, b in zip([0, *found], found) if b > a + 1}
    changes = T.replay(events, f"{tmp_path}/g", lambda s: T.stream_gaps(s, "1 hour"), 4, f"{tmp_path}/gc", order_by="s")
    assert {tuple(r) for r in T.standing_gaps(changes).collect()} == want
    assert changes.where("change = 'filled'").count() > 0


def test_checks_are_idempotent_by_batch(spark, sf, tmp_path):
    from relcheck.plans.fixtures import table

    events = table(spark, sf, "run_log")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for checkpoint in ("c1", "c2"):  # the second run loses its place and starts anew
        T.stream_checks(stream, {"r": F.col("duration_ms") < 60}, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    found = M.committed(spark, f"{tmp_path}/out", "checks")
    assert found.agg(F.sum("rows")).first()[0] == events.count()
    assert {r[0] for r in found.select("batch").collect()} == {"checks-0", "checks-1", "checks-2"}


def test_a_write_that_breaks_off_is_not_seen_and_is_made_once(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "2024-01-01 10:00:00"), (1, 2, "2024-01-02 10:00:00")], "run_id long, sequence int, at string").select("run_id", "sequence", F.col("at").cast("timestamp").alias("recorded_at"))
    proof = spark.createDataFrame([(1, "seen")], "run_id long, note string")
    path = f"{tmp_path}/log"
    # one task of the second table fails after the first table, and a part of the second, have been written
    broken = spark.range(0, 8, 1, 4).select("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("note"))
    with pytest.raises(Exception, match="lost"):
        S.append_history(log, path, "b-1", broken)
    with pytest.raises(ValueError, match="nothing"):
        S.read_history(spark, path)
    assert S.append_history(log, path, "b-1", proof)
    assert not S.append_history(log.union(log), path, "b-1", proof)
    assert S.append_history(log, path, "b-2")
    with pytest.raises(Exception, match="lost"):
        S.append_history(log, path, "b-3", broken)
    rows = S.read_history(spark, path)
    assert rows.count() == 4 and rows.where("date = DATE '2024-01-02'").count() == 2 and set(rows.columns) == {"run_id", "sequence", "recorded_at", "date"}
    assert [tuple(r) for r in S.read_history(spark, path, "evidence").collect()] == [(1, "seen")]
    assert {r[0] for r in M.committed(spark, path, "history").select("batch").collect()} == {"b-1", "b-2"}
    # a record is made once, even by writers that do not see each other's
    hidden = M.is_committed
    try:
        M.is_committed, calls = lambda *a: calls.append(1) or len(calls) > 1, []
        assert not M.commit({"history": log.limit(0)}, path, "b-2") and len(calls) == 2
    finally:
        M.is_committed = hidden
    assert S.read_history(spark, path).count() == 4
    with pytest.raises(ValueError, match="batch name"):
        M.commit({"history": log}, path, "../b")


def test_gaps_forget_runs_that_are_long_over(spark, tmp_path):
    rows = [(1, 1, 0), (1, 2, 1), (1, 4, 2), (2, 1, 40), (2, 2, 41), (2, 3, 42), (1, 5, 80), (1, None, 81), (3, 2, None)]
    events = spark.createDataFrame(rows, "run_id long, sequence long, day int").select("run_id", "sequence", F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, day)").alias("recorded_at"))
    for days, want in ((30, [(1, 1, 5), (1, 3, 4)]), (365, [(1, 3, 4)])):
        found = T.replay(events, f"{tmp_path}/g{days}", lambda s, d=days: T.stream_gaps(s, "1 hour", d * 86_400_000), 6, f"{tmp_path}/gc{days}")
        assert sorted(map(tuple, T.standing_gaps(found).collect())) == want


def test_rollup_digest_by_hand(spark):
    import hashlib
    from collections import defaultdict

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(f"src/{i % 3}/{i}", sha(str(i))) for i in range(400)]
    got = {r["tree"]: (r["recorded"], r["digest"]) for r in I.checksum_rollup(spark.createDataFrame(rows, "path string, sha256 string"), F.split_part("path", F.lit("/"), F.lit(2))).collect()}
    trees = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
    for path, s in rows:
        h = sha(path)
        trees[path.split("/")[1]][h[:2]][h[:4]].append((path, s))
    for tree, firsts in trees.items():
        level = lambda parts: sha("".join(d for _, d in sorted(parts)))
        lists = lambda part: sha("".join(f"{s}  {path}\n" for path, s in sorted(part)))
        digest = level((k, level((b, lists(x)) for b, x in parts.items())) for k, parts in firsts.items())
        assert got[tree] == (sum(len(x) for parts in firsts.values() for x in parts.values()), digest)

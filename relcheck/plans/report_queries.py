"""Registered queries over reports, findings, metrics, sources and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reports as J
from ..sources import logs as S
from ..sources.commits import committed
from ..streaming import streams as T
from .fixtures import oracle, table

C = F.col
RULES = ["lint.destructive", "lint.table_rewrite", "lint.index_without_concurrently", "lint.constraint_scans_table", "lint.compatibility_window", "lint.empty_script"]


def _folder(spark) -> str:
    """A folder of one's own in the shared one."""
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not have:
        import tempfile

        spark.sparkContext.setCheckpointDir(have := tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return f"{have.rstrip('/')}/query-{uuid.uuid4().hex}"


def _allow(spark, d):
    return table(spark, d, "part").where("p_partkey < 97 AND p_partkey % 4 = 0").select(C("p_partkey").alias("package_id"), (C("p_partkey") % 3).alias("place"), F.lit("lint.destructive").alias("code"), F.concat(F.lit("ticket "), C("p_partkey").cast("string")).alias("reason"))


def _deny(spark, d):
    return table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, ["lint.destructive", "lint.table_rewrite", "lint.no_such_rule"]))).alias("code"))


def _rules(spark, d):
    return table(spark, d, "findings").select("code").distinct()


def _judged(spark, d):
    return J.apply_policy(table(spark, d, "findings"), _allow(spark, d), _deny(spark, d))


def report_documents(spark, d):
    """One JSON report a run of run_log; every 13th of another version, every 17th broken."""
    status = F.when(C("outcome") == "attempted", F.lit("blocked")).when(C("outcome").startswith("asserted"), F.lit("succeeded")).otherwise(C("outcome"))
    error = F.when(C("outcome") == "failed", F.struct(F.lit("deploy.failed").alias("code"), C("message").alias("message"), C("sqlstate").alias("sqlstate")))
    step = F.struct(C("package_id").cast("string").alias("id"), F.concat(F.lit("p-"), C("package_id")).alias("slug"), C("action").alias("action"), status.alias("status"), F.lit("required").alias("transaction"), F.sha2(C("package_id").cast("string"), 256).alias("definition_sha256"), F.array(F.struct(F.lit("deploy").alias("role"), F.lit("deploy.sql").alias("path"), status.alias("status"))).alias("scripts"), F.round("duration_ms").cast("bigint").alias("duration_ms"), error.alias("error"))
    note = F.when(C("outcome") == "attempted", F.struct(F.lit("warning").alias("severity"), F.lit("lint.empty_script").alias("code"), C("action").alias("message")))
    log = table(spark, d, "run_log")
    runs = log.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", step.alias("m")))), lambda x: x["m"]).alias("migrations"), F.collect_list(note).alias("diagnostics"), F.sum(F.round("duration_ms").cast("bigint")).alias("ms"), F.count_if(C("outcome") == "failed").alias("bad"))
    version = F.when(C("run_id") % 13 == 0, 9).otherwise(1)
    shown = F.struct(F.lit("deploy.failed").alias("code"), F.when(C("run_id") % 2 == 0, F.lit("division by zero")).otherwise(F.lit("connection lost")).alias("message"))
    run = F.struct(C("run_id").cast("string").alias("id"), F.lit("deploy").alias("command"), F.lit("2026-01-01").alias("started_at"), C("ms").alias("duration_ms"))
    body = F.to_json(F.struct(version.alias("report_version"), run.alias("run"), F.when(C("bad") > 0, F.lit("failure")).otherwise(F.lit("success")).alias("outcome"), "migrations", "diagnostics", F.when(C("bad") > 0, shown).alias("error"), F.lit("new").alias("some_later_field")))
    return runs.select(F.when(C("run_id") % 17 == 0, F.concat(F.lit("{broken "), C("run_id").cast("string"))).otherwise(body).alias("value"))


def _reports(spark, d):
    return S.parse_reports(report_documents(spark, d))[0]


def _changed_fields(spark, d):
    """The reports against others of the same runs, in which some outcomes and the status of every revert are others."""
    reports = _reports(spark, d)
    steps = F.transform("report.migrations", lambda m: F.when(m["action"] == "revert", m.withField("status", F.lit("gone"))).otherwise(m))
    outcome = F.when(C("report.run.id") % 10 == 3, F.lit("changed")).otherwise(C("report.outcome"))
    later = reports.withColumn("report", C("report").withField("outcome", outcome).withField("migrations", steps))
    return J.diff_fields(reports, later).select(C("run_id").cast("bigint").alias("run_id"), "path", F.array_join("was", ",").alias("was"), F.array_join("now", ",").alias("now"))


def _history_sink(spark, d):
    path = _folder(spark)
    log = table(spark, d, "run_log")
    S.append_history(log.where("run_id % 2 = 0"), path)
    S.append_history(log.where("run_id % 2 = 1"), path)
    return S.read_history(spark, path).groupBy(C("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs"))


def _history_stream(spark, d):
    """The log as a stream into the sink, started twice over."""
    path = _folder(spark)
    log = table(spark, d, "run_log")
    log.repartitionByRange(3, "recorded_at").write.parquet(f"{path}/in")
    for _ in range(2):
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        S.history_sink(source, f"{path}/out", f"{path}/checkpoint", "runs").trigger(availableNow=True).start().awaitTermination()
    return S.read_history(spark, f"{path}/out").groupBy("action", "outcome").agg(F.count("*").alias("n"), F.count_distinct("date").alias("days"))


def _checksum_lines(spark, d):
    docs = table(spark, d, "documents").select(C("doc_id").alias("line"), F.concat(F.when(C("doc_id") % 19 == 0, F.lit("zz")).otherwise(F.sha2("text", 256)), F.lit("  "), C("source"), F.lit("/"), (C("doc_id") - F.when(C("doc_id") % 23 == 0, 20).otherwise(0)).cast("string")).alias("value"))
    return docs.union(docs.select(-C("line") - 1, F.lit("  ")))


def _stream(spark, d, build, name="run_log", parts=5, mode="append"):
    path = _folder(spark)
    return T.replay(table(spark, d, name), path, build, parts, f"{path}/checkpoint", mode=mode)


def _checks(spark, d):
    path = _folder(spark)
    log = table(spark, d, "run_log")
    log.repartitionByRange(4, "recorded_at").write.parquet(f"{path}/in")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    T.stream_checks(source, {"fast": C("duration_ms") < 60, "coded": C("sqlstate").isNull()}, f"{path}/out", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return committed(spark, f"{path}/out", "checks").groupBy("rule").agg(F.sum("rows").alias("rows"), F.sum("failures").alias("failures"))


QUERIES = {
    "s4_append_history": _history_sink,
    "s4_history_stream": _history_stream,
    "s5_read_reports": lambda spark, d: S.parse_reports(report_documents(spark, d))[1].groupBy("reason").agg(F.count("*").alias("n")),
    "s6_parse_checksum_lines": lambda spark, d: S.parse_checksum_lines(_checksum_lines(spark, d))[1].select("line", "problem"),
    "s6_checksums": lambda spark, d: S.parse_checksum_lines(_checksum_lines(spark, d))[0],
    "j1_apply_policy": lambda spark, d: _judged(spark, d).select("package_id", "ordinal", "code", "severity", "message"),
    "j2_promoted_errors": lambda spark, d: J.promoted_errors(_judged(spark, d)).select("package_id", "ordinal", "error", "lint", "is_first"),
    "j3_unknown_denials": lambda spark, d: J.unknown_denials(_deny(spark, d), _rules(spark, d)),
    "j4_risk_counts": lambda spark, d: J.risk_counts(_judged(spark, d)),
    "j5_report_counts": lambda spark, d: J.report_counts(table(spark, d, "run_log").withColumnRenamed("outcome", "status")),
    "j5_report_summary": lambda spark, d: J.report_summary(_reports(spark, d)).select(C("run_id").cast("bigint").alias("run_id"), "applied", "verified", "warnings", "summary"),
    "j6_unshown_errors": lambda spark, d: J.unshown_errors(_reports(spark, d)).select(C("run_id").cast("bigint").alias("run_id"), "code", "message"),
    "j7_flatten_reports": lambda spark, d: J.flatten_reports(_reports(spark, d))["packages"].select(C("run_id").cast("bigint").alias("run_id"), C("id").cast("bigint").alias("package_id"), "action", "status", "duration_ms", "error_code"),
    "j7_scripts": lambda spark, d: J.flatten_reports(_reports(spark, d))["scripts"].select(C("run_id").cast("bigint").alias("run_id"), C("id").cast("bigint").alias("package_id"), "role", "path", "status"),
    "j7_diagnostics": lambda spark, d: J.flatten_reports(_reports(spark, d))["diagnostics"].groupBy("run_id").agg(F.count("*").alias("warnings"), F.max("place").alias("last"), F.array_join(F.array_sort(F.collect_set("message")), ",").alias("messages")).withColumn("run_id", C("run_id").cast("bigint")),
    "j8_diff_fields": _changed_fields,
    "j8_diff_reports": lambda spark, d: J.diff_reports(_reports(spark, d), _reports(spark, d).where("report.run.id % 10 <> 3")).select(F.sha2("report", 256).alias("report"), "in_a", "in_b").agg(F.sum(C("in_a") - C("in_b")).alias("only_in_a")),
    "j9_exit_code_of": lambda spark, d: table(spark, d, "run_log").select("run_id", "sequence", J.exit_code_of(F.when(C("outcome") == "failed", F.concat("action", F.lit(".failed"))).when(C("outcome") == "attempted", F.lit("registry.blocked"))).alias("exit_code")),
    "j10_over_budget": lambda spark, d: J.over_budget(table(spark, d, "documents").select("doc_id", "n_chars", F.size(F.split("text", "\n")).alias("lines")), {"n_chars": 4000, "lines": 20}, ["doc_id"]),
    "j11_percentile_of_one_group": lambda spark, d: J.rank_percentile(table(spark, d, "lineitem").withColumn("g", F.lit("all")), "l_extendedprice", [1, 50, 99], ["g"], most_rows=5000),
    "j11_rank_percentile": lambda spark, d: J.rank_percentile(table(spark, d, "documents"), "n_chars", [50, 90], ["source"]),
    "j12_top_n": lambda spark, d: J.top_n(table(spark, d, "documents"), "n_chars", ["doc_id"]),
    "j12_totals": lambda spark, d: J.totals(table(spark, d, "documents"), "n_chars", "doc_id", ["source"]),
    "t1_stream_failures": lambda spark, d: _stream(spark, d, lambda s: T.stream_failures(s, "1 day", "1 hour")).groupBy("action", "outcome", "sqlstate").agg(F.sum("n").alias("n")),
    "t2_stream_attempts": lambda spark, d: _stream(spark, d, lambda s: T.stream_attempts(s, 3_600_000, "1 hour")),
    "t3_stream_dedup_audit": lambda spark, d: _stream(spark, d, lambda s: T.stream_dedup(s, "60 days"), "run_log_bad").groupBy("run_id").agg(F.count("*").alias("n")),
    "t3_stream_gaps": lambda spark, d: T.standing_gaps(_stream(spark, d, lambda s: T.stream_gaps(s, "1 hour"), "run_log_bad")),
    "t4_stream_checks": _checks,
    "t5_stream_run_sessions": lambda spark, d: _stream(spark, d, lambda s: T.stream_run_sessions(s, "2 hours", "1 hour")),
}

_JUDGED = """(SELECT f.package_id, f.ordinal, f.code, CASE WHEN a.reason IS NOT NULL THEN 'note' WHEN f.code IN ('lint.destructive', 'lint.table_rewrite', 'lint.no_such_rule') THEN 'error' ELSE 'warning' END AS severity, CASE WHEN a.reason IS NOT NULL THEN f.code || ' (accepted: ' || a.reason || ')' ELSE f.code END AS message
    FROM {findings} f LEFT JOIN (SELECT p_partkey AS package_id, 'lint.destructive' AS code, 'ticket ' || p_partkey AS reason FROM {part} WHERE p_partkey < 97 AND p_partkey % 4 = 0) a ON a.package_id = f.package_id AND a.code = f.code)"""
_READ = "(SELECT * FROM {run_log} WHERE run_id % 13 <> 0 AND run_id % 17 <> 0)"

_STATUS = "CASE WHEN outcome = 'attempted' THEN 'blocked' WHEN starts_with(outcome, 'asserted') THEN 'succeeded' ELSE outcome END"

ORACLE = {
    k: oracle(v)
    for k, v in {
        "s4_history_stream": "SELECT action, outcome, count(*) AS n, count(DISTINCT CAST(recorded_at AS DATE)) AS days FROM {run_log} GROUP BY ALL",
        "s4_append_history": "SELECT CAST(CAST(recorded_at AS DATE) AS VARCHAR) AS date, count(*) AS n, count(DISTINCT run_id) AS runs FROM {run_log} GROUP BY 1",
        "s5_read_reports": "SELECT CASE WHEN run_id % 17 = 0 THEN 'malformed' ELSE 'unknown version 9' END AS reason, count(DISTINCT run_id) AS n FROM {run_log} WHERE run_id % 13 = 0 OR run_id % 17 = 0 GROUP BY 1",
        "s6_parse_checksum_lines": "WITH l AS (SELECT doc_id AS line, doc_id % 19 = 0 AS bad, source || '/' || (doc_id - CASE WHEN doc_id % 23 = 0 THEN 20 ELSE 0 END) AS path FROM {documents}), g AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM l WHERE NOT bad) SELECT line, 'malformed' AS problem FROM l WHERE bad UNION ALL SELECT line, 'listed_twice' FROM g WHERE n > 1",
        "s6_checksums": "WITH l AS (SELECT sha(text) AS sha256, source || '/' || (doc_id - CASE WHEN doc_id % 23 = 0 THEN 20 ELSE 0 END) AS path FROM {documents} WHERE doc_id % 19 <> 0), g AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM l) SELECT path, sha256 FROM g WHERE n = 1",
        "j1_apply_policy": f"SELECT package_id, ordinal, code, severity, message FROM {_JUDGED} j",
        "j2_promoted_errors": f"SELECT package_id, ordinal, 'lint.failed' AS error, code AS lint, ordinal = min(ordinal) OVER (PARTITION BY package_id) AS is_first FROM {_JUDGED} j WHERE severity = 'error'",
        "j3_unknown_denials": "SELECT c AS code FROM (VALUES ('lint.destructive'), ('lint.table_rewrite'), ('lint.no_such_rule')) t(c) WHERE c NOT IN (SELECT code FROM {findings})",
        "j4_risk_counts": f"SELECT severity, code, count(*) AS n, count(DISTINCT package_id) AS packages FROM {_JUDGED} j GROUP BY ROLLUP (severity, code)",
        "j5_report_counts": "SELECT run_id, count(*) FILTER (WHERE action = 'deploy' AND outcome = 'succeeded') AS applied, count(*) FILTER (WHERE action = 'verify' AND outcome = 'succeeded') AS verified, CAST(0 AS BIGINT) AS listed_applied, CAST(0 AS BIGINT) AS listed_pending, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM {run_log} GROUP BY run_id",
        "j5_report_summary": f"""WITH c AS (SELECT run_id, CAST(count(*) FILTER (WHERE action = 'deploy' AND outcome = 'succeeded') AS INTEGER) AS applied, CAST(count(*) FILTER (WHERE action = 'verify' AND outcome = 'succeeded') AS INTEGER) AS verified, CAST(count(*) FILTER (WHERE outcome = 'attempted') AS INTEGER) AS warnings, count(*) FILTER (WHERE outcome = 'failed') AS bad, CAST(sum(CAST(round(duration_ms) AS BIGINT)) AS BIGINT) AS ms FROM {_READ} r GROUP BY run_id),
            p AS (SELECT *, concat_ws(', ', CASE WHEN applied > 0 THEN applied || CASE WHEN applied = 1 THEN ' migration' ELSE ' migrations' END || ' applied' END, CASE WHEN verified > 0 THEN verified || ' verified' END, CASE WHEN warnings > 0 THEN warnings || CASE WHEN warnings = 1 THEN ' warning' ELSE ' warnings' END END) AS s FROM c)
            SELECT run_id, applied, verified, warnings, CASE WHEN bad = 0 AND s = '' THEN 'Nothing to do' WHEN bad = 0 THEN 'Done: ' || s WHEN s = '' THEN 'Failed' ELSE 'Failed after ' || s END || ' in ' || CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', round_even(ms / 1000.0::DOUBLE, 1)) ELSE (ms // 60000) || 'm' || ((ms % 60000) // 1000) || 's' END AS summary FROM p""",
        "j6_unshown_errors": f"SELECT run_id, 'deploy.failed' AS code, CASE WHEN run_id % 2 = 0 THEN 'division by zero' ELSE 'connection lost' END AS message FROM {_READ} r GROUP BY run_id HAVING count(*) FILTER (WHERE outcome = 'failed') > 0 AND (run_id % 2 = 1 OR count(*) FILTER (WHERE outcome = 'failed' AND message = 'division by zero') = 0)",
        "j7_flatten_reports": f"SELECT run_id, package_id, action, CASE WHEN outcome = 'attempted' THEN 'blocked' WHEN starts_with(outcome, 'asserted') THEN 'succeeded' ELSE outcome END AS status, CAST(round(duration_ms) AS BIGINT) AS duration_ms, CASE WHEN outcome = 'failed' THEN 'deploy.failed' END AS error_code FROM {_READ} r",
        "j7_scripts": f"SELECT run_id, package_id, 'deploy' AS role, 'deploy.sql' AS path, {_STATUS} AS status FROM {_READ} r",
        "j7_diagnostics": f"SELECT run_id, count(*) AS warnings, CAST(count(*) - 1 AS INTEGER) AS last, string_agg(DISTINCT action, ',' ORDER BY action) AS messages FROM {_READ} r WHERE outcome = 'attempted' GROUP BY run_id",
        "j8_diff_fields": f"""SELECT run_id, 'outcome' AS path, CASE WHEN count(*) FILTER (WHERE outcome = 'failed') > 0 THEN 'failure' ELSE 'success' END AS was, 'changed' AS now FROM {_READ} r WHERE run_id % 10 = 3 GROUP BY run_id
            UNION ALL SELECT run_id, 'migrations[' || CAST(place AS VARCHAR) || '].status', {_STATUS}, 'gone' FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sequence) - 1 AS place FROM {_READ} r) s WHERE action = 'revert'""",
        "j8_diff_reports": f"SELECT CAST(count(DISTINCT run_id) AS BIGINT) AS only_in_a FROM {_READ} r WHERE run_id % 10 = 3",
        "j9_exit_code_of": "SELECT run_id, sequence, CAST(CASE WHEN outcome = 'failed' THEN 9 WHEN outcome = 'attempted' THEN 8 ELSE 0 END AS INTEGER) AS exit_code FROM {run_log}",
        "j10_over_budget": "SELECT doc_id, 'n_chars' AS measure, CAST(n_chars AS DOUBLE) AS value, CAST(4000 AS DOUBLE) AS budget FROM {documents} WHERE n_chars > 4000 UNION ALL SELECT doc_id, 'lines', CAST(l AS DOUBLE), 20 FROM (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS l FROM {documents}) t WHERE l > 20",
        "j11_percentile_of_one_group": "SELECT 'all' AS g, CAST(p AS INTEGER) AS p, l_extendedprice AS value FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM {lineitem}) t, (VALUES (1), (50), (99)) v(p) WHERE k = (n - 1) * p // 100",
        "j11_rank_percentile": "SELECT source, CAST(p AS INTEGER) AS p, n_chars AS value FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM {documents}) t, (VALUES (50), (90)) v(p) WHERE k = (n - 1) * p // 100",
        "j12_top_n": "SELECT doc_id, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 10",
        "j12_totals": "SELECT source, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS total, max(n_chars) AS largest, (array_agg(doc_id ORDER BY n_chars DESC, doc_id DESC))[1] AS largest_key FROM {documents} GROUP BY source",
        "t1_stream_failures": "SELECT action, outcome, sqlstate, CAST(count(*) AS BIGINT) AS n FROM {run_log} WHERE date_trunc('day', recorded_at) + INTERVAL '1' DAY <= (SELECT max(recorded_at) - INTERVAL '1' HOUR FROM {run_log}) GROUP BY ALL",
        "t2_stream_attempts": """WITH k AS (SELECT package_id, run_id, sequence, outcome <> 'attempted' AS closes, epoch_us(recorded_at) // 1000 AS ms FROM {run_log}
                WHERE action IN ('deploy', 'resolve', 'baseline') AND outcome IN ('attempted', 'succeeded', 'asserted_applied', 'asserted_not_applied')),
            w AS (SELECT max(ms) - 3600000 AS w FROM k),
            e AS (SELECT k.*, coalesce(sum(CAST(closes AS INTEGER)) OVER (PARTITION BY package_id ORDER BY ms, run_id, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM k, w WHERE ms <= w),
            s AS (SELECT package_id, min(ms) FILTER (WHERE NOT closes) AS opened, min(ms) FILTER (WHERE closes) AS closed FROM e GROUP BY package_id, turn HAVING count(*) FILTER (WHERE NOT closes) > 0)
            SELECT package_id, 'opened' AS change, opened AS "at" FROM s
            UNION ALL SELECT package_id, CASE WHEN closed >= opened + 3600000 THEN 'retracted' ELSE 'closed' END, closed FROM s WHERE closed IS NOT NULL
            UNION ALL SELECT package_id, 'alert', opened + 3600000 FROM s, w WHERE coalesce(closed, w) >= opened + 3600000""",
        "t5_stream_run_sessions": """WITH g AS (SELECT *, CASE WHEN recorded_at >= lag(recorded_at) OVER w + INTERVAL '2' HOUR THEN 1 ELSE 0 END AS new FROM {run_log} WINDOW w AS (PARTITION BY package_id ORDER BY recorded_at)),
            s AS (SELECT *, sum(new) OVER (PARTITION BY package_id ORDER BY recorded_at RANGE UNBOUNDED PRECEDING) AS k FROM g),
            a AS (SELECT package_id, min(recorded_at) AS session_start, max(recorded_at) + INTERVAL '2' HOUR AS session_end, count(*) AS events, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM s GROUP BY package_id, k)
            SELECT package_id, session_start, session_end, events, failed FROM a WHERE session_end <= (SELECT max(recorded_at) - INTERVAL '1' HOUR FROM {run_log})""",
        "t3_stream_dedup_audit": "SELECT run_id, count(*) AS n FROM (SELECT DISTINCT run_id, sequence FROM {run_log_bad}) t GROUP BY run_id",
        "t3_stream_gaps": "SELECT run_id, CAST(b + 1 AS BIGINT) AS expected, CAST(sequence AS BIGINT) AS found FROM (SELECT run_id, sequence, coalesce(lag(sequence) OVER (PARTITION BY run_id ORDER BY sequence), 0) AS b FROM (SELECT DISTINCT run_id, sequence FROM {run_log_bad}) d) t WHERE sequence > b + 1",
        "t4_stream_checks": "SELECT 'fast' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT coalesce(duration_ms < 60, false)) AS failures FROM {run_log} UNION ALL SELECT 'coded', count(*), count(*) FILTER (WHERE sqlstate IS NOT NULL) FROM {run_log}",
    }.items()
}

"""Registered queries over assertion logs, catalogs and failures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assertlog as A, catalog as G, failures as L
from .fixtures import oracle, table

C = F.col
_NAME = ["db", "schema_name", "relation"]


def _log(f):
    return lambda spark, d: f(table(spark, d, "assertion_log"))


def _errors(spark, d):
    return table(spark, d, "assertion_log").where("seq = 5 AND file_id % 10 = 3").select("file_id")


def _selectors(spark, d):
    words = ["blog.ththan.example.net", "./blog.*/fr/**", "m.*/en/4*", "**/de/12?", "nowhere/at/all", "*.nowhere"]
    return table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(*map(F.lit, words))).alias("selector"))


def _expected_objects(spark, d):
    s = table(spark, d, "catalog_snapshot")
    return s.select("db", "schema_name", F.when(F.length("relation") % 3 == 0, F.concat("relation", F.lit("_gone"))).otherwise(C("relation")).alias("relation")).distinct()


def _expected_privs(spark, d):
    return table(spark, d, "grants").where("grantee <> 'PUBLIC'").groupBy("object", C("grantee").alias("role")).agg(F.collect_set("privilege").alias("privileges"))


def _search_path(spark, d):
    return table(spark, d, "catalog_snapshot").select("db", "schema_name").distinct().where("schema_name <> 's0'").withColumn("place", F.when(C("schema_name") == "s2", 1).otherwise(2))


def _throws(f, *args):
    return lambda spark, d: f(table(spark, d, "run_log").where("action = 'deploy'").select("run_id", "sequence", "sqlstate", "message"), *args).select("run_id", "sequence", "kind", "passed", "caught")


QUERIES = {
    "a1_number_assertions": _log(A.number_assertions),
    "a2_apply_todo": _log(A.apply_todo),
    "a2_todo_of_one_file": lambda spark, d: A.apply_todo(table(spark, d, "one_log"), most_rows=5000),
    "a3_expand_skips": _log(A.expand_skips),
    "a4_attach_notes": _log(A.attach_notes),
    "a5_validate_document": lambda spark, d: A.validate_document(A.assertions(table(spark, d, "assertion_log")).where("(file_id * 31 + number) % 97 <> 0"), table(spark, d, "plans").union(table(spark, d, "plans").where("file_id % 50 = 1"))),
    "a6_assertion_status": lambda spark, d: A.assertion_status(A.assertions(table(spark, d, "assertion_log"))).groupBy("file_id", "status").agg(F.count("*").alias("n")),
    "a7_file_outcome": lambda spark, d: A.file_outcome(table(spark, d, "assertion_log"), A.assertions(table(spark, d, "assertion_log").where("op <> 'assert' OR passed OR file_id % 3 > 0")), _errors(spark, d)),
    "a8_suite_outcome": lambda spark, d: A.suite_outcome(A.file_outcome(table(spark, d, "assertion_log"), A.assertions(table(spark, d, "assertion_log").where("op <> 'assert' OR passed OR file_id % 3 > 0")), _errors(spark, d)), C("file_id") % 7),
    "a9_flatten_detail": lambda spark, d: table(spark, d, "orders_expected").select("o_orderkey", "o_custkey", A.flatten_detail(F.to_json(F.struct(F.struct(F.to_json(F.struct("o_orderstatus")).alias("json"), C("o_orderstatus").alias("display")).alias("have"), F.lit("text").alias("want"), C("o_custkey").alias("n")))).alias("m")).select("o_orderkey", "o_custkey", C("m")["have"].alias("have"), C("m")["want"].alias("want"), C("m")["n"].alias("n")),
    "a10_snapshot_diff": lambda spark, d: A.snapshot_diff(table(spark, d, "snap_before"), table(spark, d, "snap_after"), "k").select("k", C("was.last_value").alias("was_value"), C("now.last_value").alias("now_value"), C("was.flag").alias("was_flag"), C("now.flag").alias("now_flag")),
    "a11_select_paths": lambda spark, d: A.select_paths(table(spark, d, "paths"), _selectors(spark, d)),
    "a12_unmatched_selectors": lambda spark, d: A.unmatched_selectors(table(spark, d, "paths"), _selectors(spark, d)),
    "g1_objects_present": lambda spark, d: G.objects_present(table(spark, d, "catalog_snapshot"), _expected_objects(spark, d)),
    "g2_objects_absent": lambda spark, d: G.objects_absent(table(spark, d, "catalog_snapshot"), _expected_objects(spark, d), "view"),
    "g3_resolve_visible": lambda spark, d: G.resolve_visible(table(spark, d, "catalog_snapshot"), table(spark, d, "catalog_snapshot"), _search_path(spark, d)),
    "g4_layout_matches": lambda spark, d: G.layout_matches(table(spark, d, "catalog_snapshot"), G.layouts(table(spark, d, "catalog_snapshot").where("column_name <> 'brand#11' OR db <> 'db0'"))),
    "g5_relations_having_all": lambda spark, d: G.relations_having_all(table(spark, d, "catalog_snapshot"), ["brand#11", "brand#12"]),
    "g6_effective_privileges": lambda spark, d: G.effective_privileges(table(spark, d, "grants"), table(spark, d, "memberships")).select("object", "role", F.array_join("privileges", ",").alias("privileges")),
    "g7_privs_are": lambda spark, d: G.privs_are(G.effective_privileges(table(spark, d, "grants"), table(spark, d, "memberships")), _expected_privs(spark, d)).select("object", "role", "passed", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected")),
    "g8_owner_is": lambda spark, d: G.owner_is(table(spark, d, "catalog_snapshot"), _expected_objects(spark, d).withColumn("owner", F.lit("owner1"))),
    "g9_roles_with_any": lambda spark, d: G.roles_with_any(table(spark, d, "memberships"), ["root", "region1"]),
    "f1_throws_ok": _throws(L.throws_ok, "23505", "duplicate key value"),
    "f2_throws_sqlstate": _throws(L.throws_sqlstate, "22012"),
    "f3_throws_like": _throws(L.throws_like, "%key%"),
    "f3_throws_ilike": _throws(L.throws_ilike, "%BY ZERO"),
    "f4_throws_matching": _throws(L.throws_matching, "^(division|relation)"),
    "f5_lives_ok": lambda spark, d: L.lives_ok(table(spark, d, "lineitem"), F.try_divide("l_extendedprice", "l_discount"), [C("l_extendedprice"), C("l_discount")], "22012").groupBy("l_returnflag", "lives", "sqlstate").agg(F.count("*").alias("n")),
    "f6_performs_ok": lambda spark, d: L.performs_ok(table(spark, d, "run_log"), "duration_ms", 200.0, ["package_id"]),
    "f7_performs_within": lambda spark, d: L.performs_within(table(spark, d, "run_log"), "duration_ms", 50.0, 8.0, ["package_id"], ["recorded_at", "run_id", "sequence"]),
}

_RESULTS = "CASE op WHEN 'assert' THEN 1 WHEN 'skip' THEN greatest(coalesce(n, 1), 0) ELSE 0 END"


def _assertions(source: str = "{assertion_log}") -> str:
    return f"""l AS (SELECT * FROM {source}), num AS (SELECT *, {_RESULTS} AS results, sum({_RESULTS}) OVER (PARTITION BY file_id ORDER BY seq) AS upto FROM l),
        dir AS (SELECT *, max(CASE WHEN op IN ('todo_start', 'todo', 'todo_end') THEN seq END) OVER (PARTITION BY file_id ORDER BY seq) AS dseq FROM num),
        todo AS (SELECT d.*, x.op AS dop, greatest(x.n, 1) AS lim, coalesce(x.text, '') AS why, count(*) FILTER (WHERE d.op = 'assert') OVER (PARTITION BY d.file_id, d.dseq ORDER BY d.seq) AS nth FROM dir d LEFT JOIN l x ON x.file_id = d.file_id AND x.seq = d.dseq),
        cov AS (SELECT *, coalesce(dop = 'todo_start' OR dop = 'todo' AND nth <= lim, false) AS todo FROM todo),
        res AS (SELECT file_id, upto AS number, passed, CASE WHEN todo THEN 'todo' END AS directive FROM cov WHERE op = 'assert' UNION ALL SELECT file_id, upto - results + k, true, 'skip' FROM cov, unnest(range(1, results + 1)) t(k) WHERE op = 'skip')"""


_EXPECTED = "(SELECT DISTINCT db, schema_name, CASE WHEN length(relation) % 3 = 0 THEN relation || '_gone' ELSE relation END AS relation FROM {catalog_snapshot})"
_CLOSED = "c AS (SELECT role, role AS member_of FROM (SELECT role FROM {memberships} UNION SELECT member_of FROM {memberships}) r UNION SELECT c.role, m.member_of FROM c JOIN {memberships} m ON m.role = c.member_of)"
_PRIVS = f"""{_CLOSED}, o AS (SELECT object, grantee AS role, privilege FROM {{grants}} WHERE grantee <> 'PUBLIC' UNION SELECT object, c.role, privilege FROM {{grants}} g JOIN c ON c.member_of = g.grantee),
    u AS (SELECT object, privilege FROM {{grants}} WHERE grantee = 'PUBLIC'), everyone AS (SELECT role FROM c UNION SELECT grantee FROM {{grants}} WHERE grantee <> 'PUBLIC'),
    h AS (SELECT * FROM o UNION SELECT u.object, e.role, u.privilege FROM u, everyone e UNION SELECT object, 'PUBLIC', privilege FROM u)"""
_FILE_OUTCOME = """SELECT f.file_id, CAST(CASE WHEN f.file_id % 10 = 3 AND has5 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS results, NOT (f.file_id % 10 = 3 AND has5) AND coalesce(failed, 0) = 0 AS passed
    FROM (SELECT file_id, bool_or(seq = 5) AS has5 FROM {assertion_log} GROUP BY file_id) f LEFT JOIN (SELECT file_id, count(*) AS n, count(*) FILTER (WHERE directive IS NULL AND NOT passed) AS failed FROM res GROUP BY file_id) r ON r.file_id = f.file_id"""
_LESS = "(SELECT * FROM {assertion_log} WHERE op <> 'assert' OR passed OR file_id % 3 > 0)"
_MET = "regexp_matches(path, '^blog\\.[^/]*/fr/.*$') OR path = 'blog.ththan.example.net' OR starts_with(path, 'blog.ththan.example.net/') OR regexp_matches(path, '^m\\.[^/]*/en/4[^/]*$') OR regexp_matches(path, '^(.*/)?de/12[^/]$')"


def _throw(kind: str, matched: str) -> str:
    return f"SELECT run_id, sequence, '{kind}' AS kind, sqlstate IS NOT NULL AND coalesce({matched}, false) AS passed, CASE WHEN sqlstate IS NULL THEN 'completed without raising' ELSE sqlstate || ': ' || message END AS caught FROM {{run_log}} WHERE action = 'deploy'"


ORACLE = {
    k: oracle(v)
    for k, v in {
        "a1_number_assertions": f"SELECT file_id, seq, op, CAST(upto - results + 1 AS BIGINT) AS first_number, CAST(results AS BIGINT) AS results FROM (SELECT *, {_RESULTS} AS results, sum({_RESULTS}) OVER (PARTITION BY file_id ORDER BY seq) AS upto FROM {{assertion_log}}) t WHERE results > 0",
        "a2_apply_todo": f"WITH {_assertions()} SELECT file_id, seq, passed, CASE WHEN todo THEN 'todo' END AS directive, CASE WHEN todo THEN why END AS directive_reason FROM cov WHERE op = 'assert'",
        "a2_todo_of_one_file": f"WITH {_assertions('{one_log}')} SELECT file_id, seq, passed, CASE WHEN todo THEN 'todo' END AS directive, CASE WHEN todo THEN why END AS directive_reason FROM cov WHERE op = 'assert'",
        "a3_expand_skips": "SELECT file_id, seq, CAST(k AS INTEGER) AS nth, true AS passed, 'skip' AS directive, coalesce(text, '') AS directive_reason FROM {assertion_log}, unnest(range(1, coalesce(n, 1) + 1)) t(k) WHERE op = 'skip'",
        "a4_attach_notes": f"SELECT file_id, seq, CAST(nullif(upto, 0) AS BIGINT) AS after_assertion, text AS message FROM (SELECT *, sum({_RESULTS}) OVER (PARTITION BY file_id ORDER BY seq) AS upto FROM {{assertion_log}}) t WHERE op = 'note'",
        "a5_validate_document": f"""WITH {_assertions()}, r AS (SELECT * FROM res WHERE (file_id * 31 + number) % 97 <> 0), g AS (SELECT file_id, number, coalesce(lag(number) OVER (PARTITION BY file_id ORDER BY number), 0) + 1 AS want FROM r),
            p AS (SELECT file_id, max(declared) AS declared, CASE WHEN file_id % 50 = 1 THEN 2 ELSE 1 END AS plans FROM {{plans}} GROUP BY file_id), n AS (SELECT file_id, count(*) AS ran FROM r GROUP BY file_id)
            SELECT file_id, 'lost' AS problem, CAST(arg_min(want, number) AS BIGINT) AS expected, CAST(min(number) AS BIGINT) AS found FROM g WHERE number <> want GROUP BY file_id
            UNION ALL SELECT file_id, 'plan_twice', 1, 2 FROM p WHERE plans = 2
            UNION ALL SELECT p.file_id, 'plan_count', declared, coalesce(ran, 0) FROM p LEFT JOIN n ON n.file_id = p.file_id WHERE plans = 1 AND declared <> coalesce(ran, 0)""",
        "a6_assertion_status": f"WITH {_assertions()} SELECT file_id, CASE WHEN directive = 'skip' THEN 'skipped' WHEN directive = 'todo' THEN CASE WHEN passed THEN 'todo_passed' ELSE 'todo_failed' END WHEN passed THEN 'passed' ELSE 'failed' END AS status, count(*) AS n FROM res GROUP BY ALL",
        "a7_file_outcome": f"WITH {_assertions(_LESS)} {_FILE_OUTCOME}",
        "a8_suite_outcome": f"WITH {_assertions(_LESS)} SELECT file_id % 7 AS suite, count(*) FILTER (WHERE NOT passed) AS failures, count(*) AS total, count(*) FILTER (WHERE NOT passed) = 0 AS passed FROM ({_FILE_OUTCOME}) o GROUP BY 1",
        "a9_flatten_detail": "SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, 'NULL') AS have, 'text' AS want, CAST(o_custkey AS VARCHAR) AS n FROM {orders_expected}",
        "a10_snapshot_diff": "SELECT b.k, b.last_value AS was_value, a.last_value AS now_value, b.flag AS was_flag, a.flag AS now_flag FROM {snap_before} b JOIN {snap_after} a ON a.k = b.k WHERE a.last_value IS DISTINCT FROM b.last_value OR a.flag IS DISTINCT FROM b.flag",
        "a11_select_paths": f"SELECT DISTINCT path FROM {{paths}} WHERE {_MET}",
        "a12_unmatched_selectors": "SELECT selector FROM (SELECT 'nowhere/at/all' AS selector UNION ALL SELECT '*.nowhere' UNION ALL SELECT 'blog.ththan.example.net' WHERE NOT EXISTS (SELECT 1 FROM {paths} WHERE path = 'blog.ththan.example.net' OR starts_with(path, 'blog.ththan.example.net/')) UNION ALL SELECT './blog.*/fr/**' WHERE NOT EXISTS (SELECT 1 FROM {paths} WHERE regexp_matches(path, '^blog\\.[^/]*/fr/.*$')) UNION ALL SELECT 'm.*/en/4*' WHERE NOT EXISTS (SELECT 1 FROM {paths} WHERE regexp_matches(path, '^m\\.[^/]*/en/4[^/]*$')) UNION ALL SELECT '**/de/12?' WHERE NOT EXISTS (SELECT 1 FROM {paths} WHERE regexp_matches(path, '^(.*/)?de/12[^/]$'))) t",
        "g1_objects_present": f"SELECT * FROM {_EXPECTED} e EXCEPT SELECT db, schema_name, relation FROM {{catalog_snapshot}} WHERE kind IN ('r', 'p')",
        "g2_objects_absent": f"SELECT * FROM {_EXPECTED} e INTERSECT SELECT db, schema_name, relation FROM {{catalog_snapshot}} WHERE kind IN ('v', 'm')",
        "g3_resolve_visible": "SELECT n.db, n.relation, min(s.schema_name) FILTER (WHERE false) AS x, max(s.schema_name) AS schema_name FROM (SELECT DISTINCT db, relation FROM {catalog_snapshot}) n LEFT JOIN {catalog_snapshot} s ON s.db = n.db AND s.relation = n.relation AND s.schema_name <> 's0' GROUP BY n.db, n.relation".replace("min(s.schema_name) FILTER (WHERE false) AS x, ", ""),
        "g4_layout_matches": "WITH a AS (SELECT db, schema_name, relation, string_agg(column_name || ':' || column_type, '|' ORDER BY column_name, column_type) AS l FROM {catalog_snapshot} GROUP BY ALL), w AS (SELECT db, schema_name, relation, string_agg(column_name || ':' || column_type, '|' ORDER BY column_name, column_type) AS l FROM {catalog_snapshot} WHERE column_name <> 'brand#11' OR db <> 'db0' GROUP BY ALL) SELECT w.db, w.schema_name, w.relation, coalesce(a.l = w.l, false) AS passed FROM w LEFT JOIN a USING (db, schema_name, relation)",
        "g5_relations_having_all": "SELECT db, schema_name, relation FROM {catalog_snapshot} WHERE column_name IN ('brand#11', 'brand#12') GROUP BY ALL HAVING count(DISTINCT column_name) = 2",
        "g6_effective_privileges": f"WITH RECURSIVE {_PRIVS} SELECT object, role, string_agg(privilege, ',' ORDER BY privilege) AS privileges FROM h GROUP BY object, role",
        "g7_privs_are": f"""WITH RECURSIVE {_PRIVS}, e AS (SELECT DISTINCT object, grantee AS role, privilege FROM {{grants}} WHERE grantee <> 'PUBLIC'),
            b AS (SELECT coalesce(h.object, e.object) AS object, coalesce(h.role, e.role) AS role, CASE WHEN h.privilege IS NULL THEN e.privilege END AS m, CASE WHEN e.privilege IS NULL THEN h.privilege END AS u FROM h FULL JOIN e ON h.object = e.object AND h.role = e.role AND h.privilege = e.privilege)
            SELECT object, role, count(m) = 0 AND count(u) = 0 AS passed, coalesce(string_agg(m, ',' ORDER BY m), '') AS missing, coalesce(string_agg(u, ',' ORDER BY u), '') AS unexpected FROM b GROUP BY object, role""",
        "g8_owner_is": f"SELECT e.db, e.schema_name, e.relation, 'owner1' AS want, min(s.owner) AS have, coalesce(min(s.owner) = 'owner1', false) AS passed FROM {_EXPECTED} e LEFT JOIN {{catalog_snapshot}} s USING (db, schema_name, relation) GROUP BY ALL",
        "g9_roles_with_any": f"WITH RECURSIVE {_CLOSED} SELECT DISTINCT role FROM c WHERE member_of IN ('root', 'region1')",
        "f1_throws_ok": _throw("throws_ok", "sqlstate = '23505' AND message = 'duplicate key value'"),
        "f2_throws_sqlstate": _throw("throws_sqlstate", "sqlstate = '22012'"),
        "f3_throws_like": _throw("throws_like", "message LIKE '%key%'"),
        "f3_throws_ilike": _throw("throws_ilike", "message ILIKE '%BY ZERO'"),
        "f4_throws_matching": _throw("throws_matching", "regexp_matches(message, '^(division|relation)')"),
        "f5_lives_ok": "SELECT l_returnflag, l_discount <> 0 AS lives, CASE WHEN l_discount = 0 THEN '22012' END AS sqlstate, count(*) AS n FROM {lineitem} GROUP BY ALL",
        "f6_performs_ok": "SELECT package_id, round(max(duration_ms), 3) AS observed_ms, max(duration_ms) < 200 AS passed FROM {run_log} GROUP BY package_id",
        "f7_performs_within": "SELECT package_id, count(*) AS iterations, round(avg(duration_ms), 3) AS mean_ms, abs(avg(duration_ms) - 50) <= 8 AS passed FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY recorded_at, run_id, sequence) AS k FROM {run_log}) t WHERE k <= 10 GROUP BY package_id",
    }.items()
}

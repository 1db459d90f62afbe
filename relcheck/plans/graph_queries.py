"""Registered queries over graphs and change history, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as H, history as I
from .fixtures import oracle, table

C = F.col


def _g(f, nodes="nodes", edges="edges"):
    return lambda spark, d: f(table(spark, d, nodes), table(spark, d, edges))


def _packages(spark, d):
    depends = table(spark, d, "edges").groupBy("project", C("child").alias("id")).agg(F.collect_list("parent").alias("depends"))
    return table(spark, d, "defs_source").join(depends, ["project", "id"], "left")


def _targets(spark, d):
    return table(spark, d, "nodes").where("id % 131 = 7")


def _attempts(spark, d):
    return table(spark, d, "nodes").where("id % 43 = 0").select("project", "id").union(table(spark, d, "nodes").where("id % 401 = 0").select("project", C("id") + 20_000_000))


def _four(spark, d):
    return [table(spark, d, n) for n in ("defs_source", "edges", "applied", "applied_edges")]


def _registries(spark, d):
    return table(spark, d, "catalog_snapshot").where("schema_name <> 's2'").select("db", "schema_name", F.concat(F.lit("p"), F.substring("owner", 6, 1)).alias("project")).distinct()


def _configured(spark, d):
    return table(spark, d, "catalog_snapshot").select("db").distinct().select("db", F.lit("s0").alias("schema_name"), F.lit("p0").alias("project"))


def _selectors(spark, d):
    p = table(spark, d, "part")
    return p.where("p_partkey % 257 = 5").select(C("p_name").alias("selector")).union(p.where("p_partkey % 257 = 6").select(F.substring(F.sha2("p_name", 256), 1, 3))).union(p.limit(1).select(F.lit("nothing-like-it")))


QUERIES = {
    "h1_edges_of": lambda spark, d: H.edges_of(_packages(spark, d)).select(C("project").cast("bigint").alias("project"), "child", "parent"),
    "h1_adjacency": lambda spark, d: H.adjacency(table(spark, d, "edges")).select("project", "id", F.array_join("dependents", ",").alias("dependents")),
    "h2_unknown_dependencies": _g(H.unknown_dependencies, edges="edges_bad"),
    "h3_invalid_edges": lambda spark, d: H.invalid_edges(table(spark, d, "edges_bad")),
    "h3_duplicate_ids": lambda spark, d: H.duplicate_ids(table(spark, d, "nodes").union(table(spark, d, "nodes").where("id % 91 = 0"))),
    "h4_heads": _g(H.heads),
    "h5_dependents_of": lambda spark, d: H.dependents_of(table(spark, d, "edges"), _targets(spark, d)),
    "h6_topological_levels": _g(H.topological_levels),
    "h7_deployment_order": _g(H.deployment_order),
    "h8_closure_of": lambda spark, d: H.closure(table(spark, d, "edges"), _targets(spark, d)),
    "h8_closure_order": lambda spark, d: H.closure_of(table(spark, d, "nodes"), table(spark, d, "edges"), _targets(spark, d)),
    "h9_cycles": lambda spark, d: H.cycles(table(spark, d, "nodes"), table(spark, d, "edges_bad")).select("project", "stuck", F.array_join("cycle", ",").alias("cycle")),
    "h9_stuck_nodes": _g(H.stuck_nodes, edges="edges_bad"),
    "h10_below_head": lambda spark, d: H.below_head(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "nodes").where("id % 3 = 0").select("project", "id").union(_targets(spark, d).select("project", "id"))),
    "i1_definition_hash": lambda spark, d: I.definition_hash(_packages(spark, d)).select("project", "id", "definition_sha256"),
    "i2_plan": lambda spark, d: I.plan(table(spark, d, "defs_source"), table(spark, d, "edges"), table(spark, d, "applied")),
    "i2_plan_status": lambda spark, d: I.plan(table(spark, d, "defs_source"), table(spark, d, "edges"), table(spark, d, "applied")).groupBy("project", "status").agg(F.count("*").alias("n")),
    "i3_missing_from_source": lambda spark, d: I.missing_from_source(table(spark, d, "defs_source"), table(spark, d, "applied")),
    "i4_changed_definitions": lambda spark, d: I.changed_definitions(*_four(spark, d)),
    "i5_unclosed_applied": lambda spark, d: I.unclosed_applied(table(spark, d, "edges"), table(spark, d, "applied")).select("project", "id", F.array_join("absent", ",").alias("absent")),
    "i6_first_error": lambda spark, d: I.first_error(*_four(spark, d)),
    "i7_current_state": lambda spark, d: I.current_state(table(spark, d, "run_log")),
    "i8_unresolved_attempts": lambda spark, d: I.unresolved_attempts(table(spark, d, "run_log")),
    "i9_status": lambda spark, d: I.status(table(spark, d, "defs_source"), table(spark, d, "applied"), _attempts(spark, d)),
    "i10_baseline_set": lambda spark, d: I.baseline_set(table(spark, d, "edges"), table(spark, d, "applied"), _targets(spark, d)),
    "i11_revertible": lambda spark, d: I.revertible(table(spark, d, "nodes"), table(spark, d, "edges"), table(spark, d, "applied")).select("project", "id", "revertible", "reason", F.array_join("dependents", ",").alias("dependents")),
    "i12_audit_append_only": lambda spark, d: I.audit_append_only(table(spark, d, "run_log_bad")),
    "i13_state_union": lambda spark, d: I.state_union(table(spark, d, "applied"), _attempts(spark, d)),
    "i14_single_owner": lambda spark, d: I.single_owner(_registries(spark, d), _configured(spark, d)),
    "i15_format_gate": lambda spark, d: I.format_gate(table(spark, d, "supplier").select(C("s_suppkey").alias("db"), F.when(C("s_suppkey") % 9 > 0, (C("s_suppkey") % 6).cast("int")).alias("format_version")), 4).select("db", "gate", F.array_join("steps", ",").alias("steps")),
    "i16_reconcile_checksums": lambda spark, d: I.reconcile_checksums(table(spark, d, "recorded_sums"), table(spark, d, "actual_sums")),
    "i16_checksum_rollup": lambda spark, d: I.checksum_rollup(table(spark, d, "recorded_sums"), F.split_part("path", F.lit("/"), F.lit(2))),
    "i17_resolve_selectors": lambda spark, d: I.resolve_selectors(table(spark, d, "part").select(F.sha2("p_name", 256).alias("id"), C("p_name").alias("slug")).distinct(), _selectors(spark, d)).select("selector", "outcome", F.size("candidates").cast("bigint").alias("n")),
    "i18_run_history": lambda spark, d: I.run_history(table(spark, d, "run_log").groupBy("run_id").agg(F.count("*").alias("events")).union(table(spark, d, "run_log").groupBy((C("run_id") + 1000000).alias("run_id")).agg(F.lit(0).cast("bigint").alias("events"))), table(spark, d, "run_log")).groupBy("run_id", "events").agg(F.count("sequence").alias("joined"), F.count_if(C("outcome") == "failed").alias("failed")),
    "i19_sequence_of_steps": lambda spark, d: I.sequence_of_steps(table(spark, d, "run_log")),
}

_TARGETS = "(SELECT project, id FROM {nodes} WHERE id % 131 = 7)"
_ATTEMPTS = "(SELECT project, id FROM {nodes} WHERE id % 43 = 0 UNION ALL SELECT project, id + 20000000 FROM {nodes} WHERE id % 401 = 0)"
_LEVELS = """WITH RECURSIVE l AS (SELECT DISTINCT CAST(project AS BIGINT) AS project, id, 0 AS level FROM {nodes} UNION SELECT e.project, e.child, l.level + 1 FROM l JOIN {edges} e ON e.project = l.project AND e.parent = l.id)"""
_CLOSURE = f"""WITH RECURSIVE c AS (SELECT CAST(project AS BIGINT) AS project, id AS target, id FROM {_TARGETS} t UNION SELECT e.project, c.target, e.parent FROM c JOIN {{edges}} e ON e.project = c.project AND e.child = c.id)"""
_ORDER = """WITH RECURSIVE p AS (SELECT n.project, n.id, coalesce(d, []) AS d FROM {nodes} n LEFT JOIN (SELECT e.project, e.child AS id, list(e.parent) AS d FROM {edges} e JOIN {nodes} m ON m.project = e.project AND m.id = e.parent GROUP BY e.project, e.child) x ON x.project = n.project AND x.id = n.id),
    k AS (SELECT project, CAST(0 AS BIGINT) AS position, CAST([] AS BIGINT[]) AS done, CAST(NULL AS BIGINT) AS id FROM (SELECT DISTINCT project FROM p) q
    UNION ALL SELECT k.project, k.position + 1, list_append(k.done, min(p.id)), min(p.id) FROM k JOIN p ON p.project = k.project WHERE NOT list_contains(k.done, p.id) AND list_has_all(k.done, p.d) GROUP BY k.project, k.position, k.done)"""
_STUCK = """WITH RECURSIVE b AS (SELECT DISTINCT project, child, parent FROM {edges_bad} e WHERE EXISTS (SELECT 1 FROM {nodes} n WHERE n.project = e.project AND n.id = e.parent)),
            r AS (SELECT project, child AS a, parent AS b FROM b UNION SELECT r.project, r.a, b.parent FROM r JOIN b ON b.project = r.project AND b.child = r.b),
            k AS (SELECT DISTINCT project, a AS id FROM r WHERE a = b)"""
_EFFECT = "CASE WHEN action IN ('deploy', 'baseline') AND outcome = 'succeeded' OR action = 'resolve' AND outcome = 'asserted_applied' THEN 'applied' WHEN action = 'revert' AND outcome = 'succeeded' OR action = 'resolve' AND outcome = 'asserted_not_applied' THEN 'absent' WHEN action = 'deploy' AND outcome = 'attempted' THEN 'blocked' END"
_FOLD = f"e AS (SELECT *, {_EFFECT} AS e FROM {{run_log}}), r AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY recorded_at DESC, run_id DESC, sequence DESC) AS k FROM e WHERE e IS NOT NULL)"
_DEPENDS = "(SELECT project, child AS id, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY parent) AS d FROM {%s} GROUP BY project, child)"
_CHANGED = f"""SELECT a.project, a.id, CASE WHEN coalesce(ad.d, '') <> coalesce(sd.d, '') THEN 'dependencies' WHEN a.mode <> s.mode THEN 'mode' ELSE 'script' END AS cause,
        CASE WHEN coalesce(ad.d, '') <> coalesce(sd.d, '') THEN coalesce(ad.d, '') WHEN a.mode <> s.mode THEN a.mode ELSE a.deploy_sha256 END AS old,
        CASE WHEN coalesce(ad.d, '') <> coalesce(sd.d, '') THEN coalesce(sd.d, '') WHEN a.mode <> s.mode THEN s.mode ELSE s.deploy_sha256 END AS new
    FROM {{applied}} a JOIN {{defs_source}} s ON a.project = s.project AND a.id = s.id LEFT JOIN {_DEPENDS % 'applied_edges'} ad ON ad.project = a.project AND ad.id = a.id LEFT JOIN {_DEPENDS % 'edges'} sd ON sd.project = a.project AND sd.id = a.id
    WHERE coalesce(ad.d, '') <> coalesce(sd.d, '') OR a.mode <> s.mode OR a.deploy_sha256 <> s.deploy_sha256"""
_UNCLOSED = "SELECT e.project, e.child AS id, string_agg(DISTINCT CAST(e.parent AS VARCHAR), ',' ORDER BY CAST(e.parent AS VARCHAR)) AS absent FROM {edges} e WHERE EXISTS (SELECT 1 FROM {applied} a WHERE a.project = e.project AND a.id = e.child) AND NOT EXISTS (SELECT 1 FROM {applied} a WHERE a.project = e.project AND a.id = e.parent) GROUP BY e.project, e.child"

ORACLE = {
    k: oracle(v)
    for k, v in {
        "h1_edges_of": "SELECT project, child, parent FROM {edges}",
        "h1_adjacency": "SELECT project, parent AS id, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS dependents FROM (SELECT DISTINCT project, parent, child FROM {edges}) e GROUP BY project, parent",
        "h2_unknown_dependencies": "SELECT DISTINCT project, child, parent FROM {edges_bad} e WHERE NOT EXISTS (SELECT 1 FROM {nodes} n WHERE n.project = e.project AND n.id = e.parent)",
        "h3_invalid_edges": "WITH c AS (SELECT project, child, parent, count(*) AS n FROM {edges_bad} GROUP BY ALL) SELECT project, child, parent, 'self' AS reason FROM c WHERE child = parent UNION ALL SELECT project, child, parent, 'duplicate' FROM c WHERE n > 1",
        "h3_duplicate_ids": "SELECT project, id, CAST(2 AS BIGINT) AS n FROM {nodes} WHERE id % 91 = 0",
        "h4_heads": "SELECT project, id FROM {nodes} n WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.project = n.project AND e.parent = n.id)",
        "h5_dependents_of": "SELECT DISTINCT project, parent, child FROM {edges} WHERE parent % 131 = 7",
        "h6_topological_levels": f"{_LEVELS} SELECT CAST(project AS INTEGER) AS project, id, max(level) AS level FROM l GROUP BY project, id",
        "h8_closure_of": f"{_CLOSURE} SELECT CAST(project AS INTEGER) AS project, target, id FROM c",
        "h7_deployment_order": f"{_ORDER} SELECT project, id, position FROM k WHERE id IS NOT NULL",
        "h8_closure_order": f"{_CLOSURE}, {_ORDER.removeprefix('WITH RECURSIVE ')} SELECT CAST(c.project AS INTEGER) AS project, c.target, c.id, k.position FROM c LEFT JOIN k ON k.project = c.project AND k.id = c.id",
        "h9_cycles": f"""{_STUCK}, s AS (SELECT project, id FROM k UNION SELECT r.project, r.a FROM r JOIN k ON k.project = r.project AND k.id = r.b),
            f AS (SELECT b.project, b.child AS id, min(b.parent) AS next FROM b JOIN s c ON c.project = b.project AND c.id = b.child JOIN s p ON p.project = b.project AND p.id = b.parent GROUP BY b.project, b.child),
            w AS (SELECT project, min(id) AS id, [min(id)] AS path FROM f GROUP BY project UNION ALL SELECT w.project, f.next, list_append(w.path, f.next) FROM w JOIN f ON f.project = w.project AND f.id = w.id WHERE len(list_distinct(w.path)) = len(w.path)),
            o AS (SELECT project, path[list_position(path, id):len(path) - 1] AS ring FROM w WHERE len(list_distinct(path)) < len(path)),
            t AS (SELECT project, ring, list_position(ring, list_min(ring)) AS m FROM o)
            SELECT CAST(t.project AS INTEGER) AS project, (SELECT count(*) FROM f WHERE f.project = t.project) AS stuck, array_to_string(list_concat(ring[m:], ring[:m - 1]), ',') AS cycle FROM t""",
        "h9_stuck_nodes": f"{_STUCK} SELECT CAST(project AS INTEGER) AS project, id FROM k UNION SELECT CAST(r.project AS INTEGER), r.a FROM r JOIN k ON k.project = r.project AND k.id = r.b",
        "h10_below_head": f"SELECT DISTINCT project, id FROM (SELECT project, id FROM {{nodes}} WHERE id % 3 = 0 UNION ALL SELECT * FROM {_TARGETS} t) q WHERE EXISTS (SELECT 1 FROM {{edges}} e WHERE e.project = q.project AND e.parent = q.id)",
        "i1_definition_hash": "SELECT s.project, s.id, sha('definition-v1' || chr(10) || 'id=' || s.id || chr(10) || 'transaction=' || mode || chr(10) || 'depends=' || coalesce(d, '') || chr(10) || 'deploy_sha256=' || deploy_sha256 || chr(10)) AS definition_sha256 FROM {defs_source} s LEFT JOIN (SELECT project, child AS id, string_agg(CAST(parent AS VARCHAR), ',' ORDER BY CAST(parent AS VARCHAR)) AS d FROM {edges} GROUP BY project, child) x ON x.project = s.project AND x.id = s.id",
        "i2_plan": f"{_ORDER} SELECT s.project, s.id, k.position, CASE WHEN EXISTS (SELECT 1 FROM {{applied}} a WHERE a.project = s.project AND a.id = s.id) THEN 'applied' ELSE 'pending' END AS status FROM {{defs_source}} s JOIN k ON k.project = s.project AND k.id = s.id",
        "i2_plan_status": "SELECT s.project, CASE WHEN EXISTS (SELECT 1 FROM {applied} a WHERE a.project = s.project AND a.id = s.id) THEN 'applied' ELSE 'pending' END AS status, count(*) AS n FROM {defs_source} s GROUP BY ALL",
        "i3_missing_from_source": "SELECT project, id FROM {applied} EXCEPT SELECT project, id FROM {defs_source}",
        "i4_changed_definitions": _CHANGED,
        "i5_unclosed_applied": _UNCLOSED.replace("string_agg(DISTINCT CAST(e.parent AS VARCHAR), ',' ORDER BY CAST(e.parent AS VARCHAR))", "array_to_string(list_sort(list(DISTINCT e.parent)), ',')").replace("SELECT e.project", "SELECT CAST(e.project AS INTEGER) AS project"),
        "i6_first_error": f"""WITH m AS (SELECT project, id FROM {{applied}} EXCEPT SELECT project, id FROM {{defs_source}}), c AS ({_CHANGED}), u AS ({_UNCLOSED}),
            a AS (SELECT project, id, 0 AS k, 'missing' AS error FROM m UNION ALL SELECT project, id, 1, 'changed' FROM c UNION ALL SELECT CAST(project AS INTEGER), id, 2, 'unclosed' FROM u)
            SELECT project, id, error FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY k, id) AS n FROM a) t WHERE n = 1""",
        "i7_current_state": f"WITH {_FOLD} SELECT p.package_id, CASE WHEN r.e IN ('applied', 'blocked') THEN r.e ELSE 'pending' END AS state, r.recorded_at FROM (SELECT DISTINCT package_id FROM {{run_log}}) p LEFT JOIN r ON r.package_id = p.package_id AND k = 1",
        "i8_unresolved_attempts": f"WITH {_FOLD}, c AS (SELECT package_id, min(k) AS c FROM r WHERE e <> 'blocked' GROUP BY package_id) SELECT r.package_id, min(recorded_at) AS started_at, count(*) AS attempts FROM r LEFT JOIN c ON c.package_id = r.package_id WHERE e = 'blocked' AND (c IS NULL OR k < c) GROUP BY r.package_id",
        "i9_status": f"SELECT k.project, k.id, CASE WHEN t.id IS NOT NULL THEN 'blocked' WHEN a.id IS NOT NULL THEN 'applied' ELSE 'pending' END AS status, s.id IS NOT NULL AS in_source FROM (SELECT project, id FROM {{defs_source}} UNION SELECT project, id FROM {{applied}} UNION SELECT project, id FROM {_ATTEMPTS} z) k LEFT JOIN (SELECT DISTINCT project, id FROM {{defs_source}}) s USING (project, id) LEFT JOIN (SELECT DISTINCT project, id FROM {{applied}}) a USING (project, id) LEFT JOIN (SELECT DISTINCT project, id FROM {_ATTEMPTS} y) t USING (project, id)",
        "i10_baseline_set": f"{_CLOSURE} SELECT DISTINCT CAST(project AS INTEGER) AS project, id FROM c WHERE NOT EXISTS (SELECT 1 FROM {{applied}} a WHERE a.project = c.project AND a.id = c.id)",
        "i11_revertible": """SELECT n.project, n.id, d IS NULL AND n.reversible AND trim(n.payload) <> '' AS revertible, CASE WHEN d IS NOT NULL THEN 'dependents' WHEN NOT n.reversible THEN 'irreversible' WHEN trim(n.payload) = '' THEN 'no_script' END AS reason, coalesce(d, '') AS dependents
            FROM {nodes} n LEFT JOIN (SELECT e.project, e.parent AS id, string_agg(CAST(e.child AS VARCHAR), ',' ORDER BY e.child) AS d FROM {edges} e WHERE EXISTS (SELECT 1 FROM {applied} a WHERE a.project = e.project AND a.id = e.child) GROUP BY e.project, e.parent) x ON x.project = n.project AND x.id = n.id
            WHERE EXISTS (SELECT 1 FROM {applied} a WHERE a.project = n.project AND a.id = n.id)""",
        "i12_audit_append_only": """WITH d AS (SELECT run_id, sequence, count(*) AS n, min(recorded_at) AS f, max(recorded_at) AS l FROM {run_log_bad} GROUP BY run_id, sequence), s AS (SELECT *, lag(sequence) OVER w AS b, lag(l) OVER w AS e FROM d WINDOW w AS (PARTITION BY run_id ORDER BY sequence))
            SELECT run_id, 'duplicate' AS problem, sequence FROM s WHERE n > 1 UNION ALL SELECT run_id, 'start', sequence FROM s WHERE b IS NULL AND sequence <> 1 UNION ALL SELECT run_id, 'gap', sequence FROM s WHERE sequence - b > 1 UNION ALL SELECT run_id, 'backwards', sequence FROM s WHERE f < e""",
        "i13_state_union": f"SELECT 'applied' AS kind, project, id FROM {{applied}} UNION ALL SELECT 'attempt', project, id FROM {_ATTEMPTS} t",
        "i14_single_owner": "WITH r AS (SELECT DISTINCT db, schema_name, 'p' || substr(owner, 6, 1) AS project FROM {catalog_snapshot} WHERE schema_name <> 's2'), f AS (SELECT db, count(*) AS owners, min(schema_name) AS s, min(project) AS p FROM r GROUP BY db) SELECT c.db, coalesce(owners, 0) AS owners, CASE WHEN owners IS NULL THEN 'none' WHEN owners > 1 THEN 'several' WHEN p <> 'p0' THEN 'other_project' WHEN s <> 's0' THEN 'other_schema' ELSE 'owned' END AS verdict FROM (SELECT DISTINCT db FROM {catalog_snapshot}) c LEFT JOIN f ON f.db = c.db",
        "i15_format_gate": "SELECT db, CASE WHEN v IS NULL THEN 'uninitialised' WHEN v > 4 THEN 'too_new' WHEN v = 4 THEN 'current' ELSE 'upgrade' END AS gate, CASE WHEN v < 4 THEN array_to_string(range(v + 1, 5), ',') ELSE '' END AS steps FROM (SELECT s_suppkey AS db, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey % 6 END AS v FROM {supplier}) t",
        "i16_reconcile_checksums": "SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unrecorded' ELSE 'modified' END AS status FROM {recorded_sums} a FULL JOIN {actual_sums} b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256",
        "i16_checksum_rollup": "WITH p AS (SELECT split_part(path, '/', 2) AS tree, left(sha(path), 4) AS bucket, count(*) AS n, sha256(string_agg(sha256 || '  ' || path || chr(10), '' ORDER BY path)) AS d FROM {recorded_sums} GROUP BY ALL), b AS (SELECT tree, left(bucket, 2) AS bucket, sum(n) AS n, sha256(string_agg(d, '' ORDER BY bucket)) AS d FROM p GROUP BY tree, left(bucket, 2)) SELECT tree, CAST(sum(n) AS BIGINT) AS recorded, sha256(string_agg(d, '' ORDER BY bucket)) AS digest FROM b GROUP BY tree",
        "i17_resolve_selectors": "WITH p AS (SELECT DISTINCT sha(p_name) AS id, p_name AS slug FROM {part}), s AS (SELECT p_name AS selector FROM {part} WHERE p_partkey % 257 = 5 UNION SELECT left(sha(p_name), 3) FROM {part} WHERE p_partkey % 257 = 6 UNION SELECT 'nothing-like-it'), m AS (SELECT selector, count(DISTINCT id) AS n FROM s LEFT JOIN p ON starts_with(id, selector) OR slug = selector GROUP BY selector) SELECT selector, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, n FROM m",
        "i18_run_history": "SELECT run_id, count(*) AS events, count(*) AS joined, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM {run_log} GROUP BY run_id UNION ALL SELECT DISTINCT run_id + 1000000, 0, 0, 0 FROM {run_log}",
        "i19_sequence_of_steps": "SELECT run_id, sequence, package_id, CASE WHEN coalesce(max(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'skipped' ELSE outcome END AS status FROM {run_log}",
    }.items()
}

"""Tables derived from the base tables, defined once in SQL that Spark and the oracle both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: {name} stands for another table, sha(x) for the hexadecimal SHA-256 of a string.
DERIVED: dict[str, str] = {
    "orders_expected": """
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 137 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
            CASE WHEN o_orderkey % 149 = 0 THEN CAST(NULL AS DOUBLE) ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
        FROM {orders} WHERE o_orderkey % 101 <> 0
        UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM {orders} WHERE o_orderkey % 211 = 0""",
    "nodes": """
        SELECT CAST(p_partkey % 16 AS INT) AS project, p_partkey AS id, p_name AS label, p_brand AS payload,
            CASE WHEN p_size % 10 = 0 THEN 'forbidden' ELSE 'required' END AS mode, p_size % 7 <> 0 AS reversible FROM {part}""",
    "edges": """
        SELECT DISTINCT project, child, parent FROM (
            SELECT p_partkey % 16 AS project, p_partkey AS child, CAST(floor(floor(p_partkey / 16) / 2) * 16 + p_partkey % 16 AS BIGINT) AS parent FROM {part} WHERE p_partkey >= 16
            UNION ALL SELECT p_partkey % 16, p_partkey, CAST(floor(floor(p_partkey / 16) / 3) * 16 + p_partkey % 16 AS BIGINT) FROM {part} WHERE p_partkey >= 16) e""",
    "edges_bad": """
        SELECT project, child, parent FROM {edges}
        UNION ALL SELECT project, child, -child AS parent FROM {edges} WHERE child % 97 = 0
        UNION ALL SELECT project, child, child FROM {edges} WHERE child % 103 = 0
        UNION ALL SELECT project, child, parent FROM {edges} WHERE child % 107 = 0
        UNION ALL SELECT project, parent, child FROM {edges} WHERE child % 89 = 0""",
    "run_log": """
        SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS sequence, ts AS recorded_at, event_id % 97 AS package_id,
            CASE WHEN event_id % 29 = 0 THEN 'resolve' WHEN event_type = 'view' THEN 'verify' WHEN event_type = 'click' THEN 'revert' ELSE 'deploy' END AS action,
            CASE WHEN event_id % 29 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'asserted_applied' ELSE 'asserted_not_applied' END
                WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'attempted' ELSE 'succeeded' END AS outcome,
            CASE WHEN event_type = 'error' AND event_id % 29 <> 0 THEN CASE event_id % 3 WHEN 0 THEN '22012' WHEN 1 THEN '23505' ELSE '42P01' END END AS sqlstate,
            CASE WHEN event_type = 'error' AND event_id % 29 <> 0 THEN CASE event_id % 3 WHEN 0 THEN 'division by zero' WHEN 1 THEN 'duplicate key value' ELSE 'relation does not exist' END END AS message,
            value AS duration_ms FROM {events}""",
    "run_log_bad": """
        SELECT * FROM {run_log} WHERE NOT (sequence % 31 = 0 AND run_id % 5 = 0)
        UNION ALL SELECT * FROM {run_log} WHERE sequence = 7 AND run_id % 6 = 0""",
    "assertion_log": """
        SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq,
            CASE WHEN event_id % 41 = 0 THEN 'todo_start' WHEN event_id % 43 = 0 THEN 'todo_end' WHEN event_id % 47 = 0 THEN 'todo' WHEN event_id % 53 = 0 THEN 'skip'
                WHEN event_type = 'view' THEN 'note' ELSE 'assert' END AS op,
            event_type <> 'error' AS passed, CAST(event_id % 4 AS INT) AS n, concat('reason ', CAST(event_id % 5 AS VARCHAR(10))) AS text FROM {events}""",
    "one_log": "SELECT CAST(0 AS BIGINT) AS file_id, seq * CAST(100000000 AS BIGINT) + file_id AS seq, op, passed, n, text FROM {assertion_log}",
    "grants": """
        SELECT DISTINCT concat('obj', CAST(s_suppkey % 20 AS VARCHAR(20))) AS object,
            CASE WHEN s_suppkey % 11 = 0 THEN 'PUBLIC' WHEN s_suppkey % 3 = 0 THEN concat('region', CAST(s_nationkey % 5 AS VARCHAR(20))) ELSE concat('nation', CAST(s_nationkey AS VARCHAR(20))) END AS grantee,
            CASE s_suppkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'UPDATE' ELSE 'DELETE' END AS privilege FROM {supplier}""",
    "memberships": """
        SELECT concat('nation', CAST(n_nationkey AS VARCHAR(20))) AS role, concat('region', CAST(n_regionkey AS VARCHAR(20))) AS member_of FROM {nation}
        UNION ALL SELECT concat('region', CAST(r_regionkey AS VARCHAR(20))), 'root' FROM {region} WHERE r_regionkey % 2 = 0""",
    "catalog_snapshot": """
        SELECT DISTINCT concat('db', CAST(p_size % 4 AS VARCHAR(20))) AS db, concat('s', CAST(p_size % 3 AS VARCHAR(20))) AS schema_name, lower(p_type) AS relation,
            CASE WHEN length(p_type) % 2 = 0 THEN 'r' ELSE 'v' END AS kind, lower(p_brand) AS column_name, CASE WHEN length(p_brand) % 2 = 0 THEN 'bigint' ELSE 'text' END AS column_type,
            concat('owner', CAST(p_size % 3 AS VARCHAR(20))) AS owner FROM {part}""",
    "recorded_sums": """
        SELECT concat('src/', source, '/', CAST(doc_id AS VARCHAR(20))) AS path, CASE WHEN doc_id % 17 = 0 THEN repeat('0', 64) ELSE sha(text) END AS sha256
        FROM {documents} WHERE doc_id % 23 <> 0""",
    "actual_sums": "SELECT concat('src/', source, '/', CAST(doc_id AS VARCHAR(20))) AS path, sha(text) AS sha256 FROM {documents} WHERE doc_id % 19 <> 0",
    "findings": """
        SELECT l_orderkey % 97 AS package_id, CAST(row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS BIGINT) AS ordinal,
            CASE l_linenumber % 6 WHEN 0 THEN 'lint.destructive' WHEN 1 THEN 'lint.table_rewrite' WHEN 2 THEN 'lint.index_without_concurrently'
                WHEN 3 THEN 'lint.constraint_scans_table' WHEN 4 THEN 'lint.compatibility_window' ELSE 'lint.empty_script' END AS code
        FROM {lineitem}""",
    "plans": """
        SELECT file_id, CAST(count(*) + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS declared FROM {assertion_log} WHERE op = 'assert' GROUP BY file_id""",
    "paths": "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM {pages}",
    "spans": "SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS start_ts, o_orderdate + INTERVAL '3' DAY AS end_ts FROM {orders}",
    "snap_before": "SELECT o_custkey AS k, max(o_orderkey) AS last_value, max(o_orderstatus) AS flag FROM {orders} WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey",
    "snap_after": "SELECT o_custkey AS k, max(o_orderkey) AS last_value, max(o_orderstatus) AS flag FROM {orders} GROUP BY o_custkey",
    "defs_source": "SELECT n.project, n.id, n.mode, n.payload, sha(n.payload) AS deploy_sha256 FROM {nodes} n",
    "applied": """
        SELECT project, id, CASE WHEN id % 59 = 0 THEN 'other' ELSE mode END AS mode, CASE WHEN id % 53 = 0 THEN sha(concat(payload, '!')) ELSE deploy_sha256 END AS deploy_sha256
        FROM {defs_source} WHERE id % 5 <> 0 AND id % 67 <> 0
        UNION ALL SELECT project, id + 10000000, mode, deploy_sha256 FROM {defs_source} WHERE id % 71 = 0""",
    "applied_edges": "SELECT e.project, e.child, e.parent FROM {edges} e WHERE e.child % 61 <> 0",
}

_SHA = re.compile(r"\bsha\(((?:[^()]|\([^()]*\))*)\)")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived one, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _SHA.sub(r"sha2(\1, 256)", DERIVED[name])
    return spark.sql(text, **{x: table(spark, sf_dir, x) for x in dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text))})


def _needs(name: str) -> list[str]:
    out: list[str] = []
    for x in re.findall(r"\{([a-z]\w*)\}", DERIVED.get(name, "")):
        out += [y for y in [*_needs(x), x] if y in DERIVED and y not in out]
    return out


def oracle(sql: str) -> str:
    """SQL with {name} for tables, as one statement for the oracle: derived tables become CTEs in front."""
    wanted: list[str] = []
    for x in re.findall(r"\{([a-z]\w*)\}", sql):
        wanted += [y for y in [*_needs(x), x] if y in DERIVED and y not in wanted]
    plain = lambda s: _SHA.sub(r"sha256(\1)", re.sub(r"\{([a-z]\w*)\}", r"\1", s))
    parts = [f"{x} AS ({plain(DERIVED[x])})" for x in wanted]
    body = plain(sql).strip()
    if not parts:
        return body
    if re.match(r"(?i)WITH\s+RECURSIVE\s", body):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + re.sub(r"(?i)^WITH\s+RECURSIVE\s+", "", body)
    if re.match(r"(?i)WITH\s", body):
        return "WITH " + ", ".join(parts) + ", " + re.sub(r"(?i)^WITH\s+", "", body)
    return "WITH " + ", ".join(parts) + " " + body

"""Registered queries over scalar functions, row predicates and constraints, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import constraints as K, rows as P
from .fixtures import oracle, table

C = F.col


def _t(name):
    return lambda spark, d: table(spark, d, name)


def _rows(name, f):
    return lambda spark, d: f(table(spark, d, name))


_SPELLED = "CASE event_id % 8 WHEN 0 THEN concat(event_id % 90, 's') WHEN 1 THEN concat(event_id % 1000, 'ms') WHEN 2 THEN concat(event_id % 60, ' min') WHEN 3 THEN concat(event_id % 24, 'hours') WHEN 4 THEN concat(' ', event_id, ' ') WHEN 5 THEN concat(event_id, 'd') WHEN 6 THEN concat('99999999999999999', event_id % 10, 'h') ELSE '' END"
_UUID_TEXT = "concat(substr(sha(url), 1, 8), '-', substr(sha(url), 9, 4), '-7', substr(sha(url), 13, 3), '-8', substr(sha(url), 16, 3), '-', substr(sha(url), 19, 12))"
_PACKAGE = f"CASE page_id % 3 WHEN 0 THEN concat({_UUID_TEXT}, '-page-', page_id) WHEN 1 THEN {_UUID_TEXT} ELSE concat('page-', page_id) END"


def _sample(check, by):
    """The failing rows that a check shows, one row each, by their place in the sample."""
    shown = check.select(by, "failures", F.posexplode("sample").alias("place", "v"))
    names = [f.name for f in shown.schema["v"].dataType.fields]
    return shown.select(by, "failures", (C("place") + 1).alias("place"), *(C(f"v.{n}.{part}").alias(f"{n}_{part}") for n in names for part in ("display", "type", "is_null")))


def _sample_sql(source: str, by: str, failing: str, identity: str, **shown: tuple[str, str]) -> str:
    """The 20 failing rows of each group with the least MD5 of their identity; shown: of each value its text and type."""
    values = ", ".join(f"{x} AS {n}_display, '{kind}' AS {n}_type, {x} IS NULL AS {n}_is_null" for n, (x, kind) in shown.items())
    ties = ", ".join(f"{x} NULLS FIRST" for x, _ in shown.values())
    rows = f"SELECT {by}, count(*) OVER (PARTITION BY {by}) AS failures, CAST(row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws('|', {identity})), {ties}) AS INTEGER) AS place, {values} FROM {{{source}}} WHERE {failing}"
    return f"SELECT * FROM ({rows}) t WHERE place <= 20"


def _spark_sql(text: str) -> str:
    import re

    return re.sub(r"\bsha\((\w+)\)", r"sha2(\1, 256)", text)


QUERIES = {
    "x1_parse_duration_ms": _rows("events", lambda e: e.select("event_id", F.expr(_SPELLED).alias("text")).select("event_id", X.parse_duration_ms(C("text")).alias("ms"))),
    "x2_format_duration": _rows("events", lambda e: e.select("event_id", (C("event_id") * F.when(C("event_id") % 3 == 0, 1000).when(C("event_id") % 7 == 0, 3600000).otherwise(1)).alias("ms")).select("event_id", X.format_duration(C("ms")).alias("exact"), X.human_duration(C("ms")).alias("human"))),
    "x3_normalize_slug": _rows("documents", lambda d: d.select("doc_id", X.normalize_slug(C("text")).alias("slug"))),
    "x4_split_package_name": _rows("pages", lambda p: p.select("page_id", X.split_package_name(F.expr(_spark_sql(_PACKAGE))).alias("s")).select("page_id", "s.id", "s.slug", "s.short_id")),
    "x5_quote_identifier": _rows("part", lambda p: p.select("p_partkey", X.quote_identifier(F.concat("p_name", F.lit('"'), "p_brand")).alias("quoted"))),
    "x6_line_and_column": _rows("documents", lambda d: d.select("doc_id", X.line_and_column(C("text"), F.floor(F.length("text") / 2)).alias("p")).select("doc_id", "p.line", "p.column")),
    "x7_stable_key": _rows("part", lambda p: p.select("p_partkey", X.stable_key(C("p_name")).alias("key"))),
    "x8_uuid_version": _rows("pages", lambda p: p.select("page_id", X.uuid_version(F.expr(_spark_sql(f"CASE WHEN page_id % 4 = 0 THEN url ELSE {_UUID_TEXT} END"))).alias("version"))),
    "x9_glob_to_regex": lambda spark, d: table(spark, d, "paths").select("page_id", "path", F.explode(F.array(*map(F.lit, ("blog.*/en/*", "**/de/**", "*.com/**/?", "[a-m]*/**", "plain")))).alias("glob")).where(F.coalesce(F.regexp_like(C("path"), X.glob_to_regex(C("glob"))), F.lit(False))).select("page_id", "glob"),
    "x10_sha256_hex": _rows("documents", lambda d: d.select("doc_id", X.sha256_hex(C("text")).alias("sha256"))),
    "p1_ok": _rows("orders_expected", lambda o: P.ok(o, C("o_totalprice") > 1000, ["o_orderpriority"])),
    "p2_is_equal": _rows("orders_expected", lambda o: P.is_equal(o, C("o_orderstatus"), F.lit("O"), ["o_orderpriority"])),
    "p3_isnt_equal": _rows("orders_expected", lambda o: P.isnt_equal(o, C("o_totalprice"), F.lit(None).cast("double"))),
    "p4_matches": _rows("part", lambda p: P.matches(p, C("p_name"), "[aeiou]{2}", ["p_size"])),
    "p5_imatches": _rows("part", lambda p: P.imatches(p, C("p_brand"), "BRAND#[12]", ["p_size"])),
    "p6_doesnt_match": _rows("orders_expected", lambda o: P.doesnt_match(o, C("o_totalprice"), "9$", ["o_orderstatus"])),
    "p7_cmp_ok": _rows("lineitem", lambda t: P.cmp_ok(t, C("l_discount"), "<=", F.lit(0.05), ["l_returnflag", "l_linestatus"])),
    "p8_isa_ok": _rows("events", lambda e: P.isa_ok(e, C("props"), "BIGINT", ["event_type"], "$.k")),
    "p1_ok_sample": _rows("orders_expected", lambda o: _sample(P.ok(o, C("o_totalprice") > 50000, ["o_orderpriority"], 20, ["o_orderkey"]), "o_orderpriority")),
    "p2_is_equal_sample": _rows("orders_expected", lambda o: _sample(P.is_equal(o, C("o_orderstatus"), F.lit("O"), ["o_orderpriority"], 20, ["o_orderkey"]), "o_orderpriority")),
    "p3_isnt_equal_sample": _rows("part", lambda p: _sample(P.isnt_equal(p, C("p_size"), F.lit(7), ["p_size"], 20, ["p_partkey"]), "p_size")),
    "p4_matches_sample": _rows("part", lambda p: _sample(P.matches(p, C("p_name"), "[aeiou]{2}", ["p_size"], 20, ["p_partkey"]), "p_size")),
    "p5_imatches_sample": _rows("part", lambda p: _sample(P.imatches(p, C("p_brand"), "BRAND#[12]", ["p_size"], 20, ["p_partkey"]), "p_size")),
    "p6_doesnt_match_sample": _rows("part", lambda p: _sample(P.doesnt_match(p, C("p_type"), "E", ["p_brand"], 20, ["p_partkey"]), "p_brand")),
    "p7_cmp_ok_sample": _rows("lineitem", lambda t: _sample(P.cmp_ok(t, C("l_linenumber"), "<=", F.lit(3), ["l_returnflag"], 20, ["l_orderkey", "l_linenumber"]), "l_returnflag")),
    "p8_isa_ok_sample": _rows("events", lambda e: _sample(P.isa_ok(e, C("props"), "STRING", ["event_type"], "$.k", 20, ["event_id"]), "event_type")),
    "p9_describe": _rows("orders_expected", lambda o: o.select("o_orderkey", "o_custkey", P.describe(C("o_orderstatus"), "string").alias("d"), P.describe(C("o_totalprice"), "double").alias("e")).select("o_orderkey", "o_custkey", C("d.json").alias("status_json"), C("d.display").alias("status_display"), C("e.type").alias("price_type"), C("e.is_null").alias("price_is_null"))),
    "p_check_all": _rows("lineitem", lambda t: P.check_all(t, {"discount": C("l_discount") <= 0.05, "quantity": C("l_quantity") > 1, "tax": C("l_tax") < 1}, ["l_returnflag"])),
    "k1_col_not_null": _rows("orders_expected", lambda o: K.col_not_null(o, ["o_orderkey", "o_totalprice", "o_comment"])),
    "k1_col_is_null": _rows("orders_expected", lambda o: K.col_is_null(o, ["o_orderkey", "o_totalprice", "o_comment"])),
    "k2_col_type_is": _rows("part", lambda p: K.col_type_is(p, "p_brand", "character varying(8)").unionByName(K.col_type_is(p, "p_size", "smallint")).unionByName(K.col_type_is(p, "p_name", "double precision")).unionByName(K.col_type_is(p, "p_name", "nosuchtype")).unionByName(K.col_type_is(p, "p_comment", "text"))),
    "k3_col_has_default": _rows("orders_expected", lambda o: K.col_has_default(o, "o_orderstatus", 0.3)),
    "k3_col_hasnt_default": _rows("events", lambda e: K.col_hasnt_default(e, "event_type", 0.5)),
    "k3_col_default_is": _rows("events", lambda e: K.col_default_is(e, "event_type", "view", 0.1).unionByName(K.col_default_is(e.withColumn("flag", F.when(C("event_id") % 5 > 0, 7)), "flag", "7")).unionByName(K.col_default_is(e, "user_id", "x"))),
    "k4_has_pk": _rows("lineitem", lambda t: K.has_pk(t, ["l_orderkey", "l_linenumber"])),
    "k4_col_is_pk": _rows("orders", lambda o: K.col_is_pk(o, ["o_orderkey"])),
    "k5_has_field": _rows("events", lambda e: K.has_field(e, "props", "k", ["event_type"])),
    "k5_hasnt_field": _rows("events", lambda e: K.hasnt_field(e, "props", "missing", ["event_type"])),
    "k6_accepted_values": _rows("events", lambda e: K.accepted_values(e, "event_type", ["view", "click", "signup", "refund"]).select("column", "passed", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))),
    "k7_domain_ok": _rows("lineitem", lambda t: K.domain_ok(t, "l_discount", "decimal(4,2)", C("l_discount") < 0.1)),
    "k8_validate_unique": _rows("part", lambda p: K.validate_unique(p, ["p_name", "p_brand"])),
    "k9_validate_foreign_key": lambda spark, d: K.validate_foreign_key(table(spark, d, "documents"), table(spark, d, "labels"), {"doc_id": "doc_id"}),
    "k9_lineitem_orders": lambda spark, d: K.validate_foreign_key(table(spark, d, "lineitem"), table(spark, d, "orders"), {"l_orderkey": "o_orderkey"}),
    "k10_validate_check": _rows("orders_expected", lambda o: K.validate_check(o, C("o_totalprice") > 1000)),
    "k11_exclusion_of_one_key": _rows("spans", lambda s: K.validate_exclusion(s.withColumn("k", F.lit(0)), "k", "start_ts", "end_ts", "id", most_rows=5000)),
    "k11_validate_exclusion": _rows("spans", lambda s: K.validate_exclusion(s, "k", "start_ts", "end_ts", "id")),
}


def _check(kind: str, source: str, predicate: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"SELECT {lead}'{kind}' AS kind, count(*) AS rows, count(*) FILTER (WHERE NOT coalesce({predicate}, false)) AS failures, count(*) FILTER (WHERE NOT coalesce({predicate}, false)) = 0 AS passed FROM {{{source}}}{group}"


def _dominant(source: str, column: str) -> str:
    return f"WITH c AS (SELECT {column} AS v, count(*) AS n FROM {{{source}}} GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS rows, max(n) AS n FROM c) SELECT '{column}' AS \"column\", rows, (SELECT CAST(max(v) AS VARCHAR) FROM c WHERE c.n = t.n) AS value, n"


_NULLS = """SELECT * FROM (SELECT 'o_orderkey' AS "column", count(*) AS rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls FROM {orders_expected}
    UNION ALL SELECT 'o_totalprice', count(*), count(*) FILTER (WHERE o_totalprice IS NULL) FROM {orders_expected} UNION ALL SELECT 'o_comment', count(*), NULL FROM {orders_expected}) t"""

ORACLE = {
    k: oracle(v)
    for k, v in {
        "x1_parse_duration_ms": f"""SELECT event_id, TRY_CAST(CASE WHEN u IS NULL THEN NULL ELSE TRY_CAST(num AS HUGEINT) * u END AS BIGINT) AS ms FROM (
            SELECT event_id, regexp_extract(trim(t), '^([0-9]+)\\s*[a-z]*$', 1) AS num, CASE regexp_extract(trim(t), '^[0-9]+\\s*([a-z]*)$', 1) WHEN '' THEN 1 WHEN 'ms' THEN 1 WHEN 's' THEN 1000 WHEN 'min' THEN 60000 WHEN 'hours' THEN 3600000 END AS u
            FROM (SELECT event_id, {_SPELLED} AS t FROM {{events}}) a) b""",
        "x2_format_duration": """SELECT event_id, CASE WHEN ms = 0 THEN '0' WHEN ms % 3600000 = 0 THEN concat(ms // 3600000, 'h') WHEN ms % 60000 = 0 THEN concat(ms // 60000, 'min') WHEN ms % 1000 = 0 THEN concat(ms // 1000, 's') ELSE concat(ms, 'ms') END AS exact,
            CASE WHEN ms < 1000 THEN concat(ms, 'ms') WHEN ms < 60000 THEN printf('%.1fs', round_even(ms / 1000.0::DOUBLE, 1)) ELSE concat(ms // 60000, 'm', (ms % 60000) // 1000, 's') END AS human
            FROM (SELECT event_id, event_id * CASE WHEN event_id % 3 = 0 THEN 1000 WHEN event_id % 7 = 0 THEN 3600000 ELSE 1 END AS ms FROM {events}) t""",
        "x3_normalize_slug": "SELECT doc_id, nullif(regexp_replace(left(lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), 80), '-+$', ''), '') AS slug FROM {documents}",
        "x4_split_package_name": f"""SELECT page_id, CASE WHEN ok THEN lower(left(n, 36)) END AS id, CASE WHEN ok THEN regexp_replace(substr(n, 37), '^-', '') ELSE '' END AS slug, CASE WHEN ok THEN lower(left(n, 8)) END AS short_id
            FROM (SELECT page_id, n, regexp_matches(left(n, 36), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS ok FROM (SELECT page_id, {_PACKAGE} AS n FROM {{pages}}) a) b""",
        "x5_quote_identifier": """SELECT p_partkey, '"' || replace(p_name || '"' || p_brand, '"', '""') || '"' AS quoted FROM {part}""",
        "x6_line_and_column": """SELECT doc_id, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(regexp_replace(b, '(?s)^.*\\n', '')) + 1 AS INTEGER) AS "column" FROM (SELECT doc_id, left(text, CAST(floor(length(text) / 2) AS INTEGER)) AS b FROM {documents}) t""",
        "x7_stable_key": "SELECT p_partkey, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS key FROM (SELECT p_partkey, CAST(CAST(('0x' || left(sha(p_name), 16)) AS UBIGINT) AS HUGEINT) AS u FROM {part}) t",
        "x8_uuid_version": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN 7 END AS version FROM {pages}",
        "x9_glob_to_regex": """SELECT page_id, g AS glob FROM {paths}, (VALUES ('blog.*/en/*', '^blog\\.[^/]*/en/[^/]*$'), ('**/de/**', '^(.*/)?de/.*$'), ('*.com/**/?', '^[^/]*\\.com/(.*/)?[^/]$'), ('[a-m]*/**', '^[a-m][^/]*/.*$')) t(g, r) WHERE regexp_matches(path, r)""",
        "x10_sha256_hex": "SELECT doc_id, sha(text) AS sha256 FROM {documents}",
        "p1_ok": _check("ok", "orders_expected", "o_totalprice > 1000", "o_orderpriority"),
        "p2_is_equal": _check("is", "orders_expected", "o_orderstatus IS NOT DISTINCT FROM 'O'", "o_orderpriority"),
        "p3_isnt_equal": _check("isnt", "orders_expected", "o_totalprice IS DISTINCT FROM NULL"),
        "p4_matches": _check("matches", "part", "regexp_matches(p_name, '[aeiou][aeiou]')", "p_size"),
        "p5_imatches": _check("imatches", "part", "regexp_matches(p_brand, '(?i)BRAND#[12]')", "p_size"),
        "p6_doesnt_match": _check("doesnt_match", "orders_expected", "NOT regexp_matches(CAST(o_totalprice AS VARCHAR), '9$')", "o_orderstatus"),
        "p7_cmp_ok": _check("cmp_ok", "lineitem", "l_discount <= 0.05", "l_returnflag, l_linestatus"),
        "p8_isa_ok": _check("isa_ok", "events", "json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')", "event_type"),
        "p1_ok_sample": _sample_sql("orders_expected", "o_orderpriority", "NOT coalesce(o_totalprice > 50000, false)", "o_orderkey", have=("CASE WHEN o_totalprice > 50000 THEN 'true' WHEN o_totalprice <= 50000 THEN 'false' END", "boolean")),
        "p2_is_equal_sample": _sample_sql("orders_expected", "o_orderpriority", "o_orderstatus IS DISTINCT FROM 'O'", "o_orderkey", have=("o_orderstatus", "string"), want=("'O'", "string")),
        "p3_isnt_equal_sample": _sample_sql("part", "p_size", "p_size = 7", "p_partkey", have=("CAST(p_size AS VARCHAR)", "int"), unwanted=("'7'", "int")),
        "p4_matches_sample": _sample_sql("part", "p_size", "NOT regexp_matches(p_name, '[aeiou][aeiou]')", "p_partkey", have=("p_name", "string"), pattern=("'[aeiou]{2}'", "string")),
        "p5_imatches_sample": _sample_sql("part", "p_size", "NOT regexp_matches(p_brand, '(?i)BRAND#[12]')", "p_partkey", have=("p_brand", "string"), pattern=("'BRAND#[12]'", "string")),
        "p6_doesnt_match_sample": _sample_sql("part", "p_brand", "regexp_matches(p_type, 'E')", "p_partkey", have=("p_type", "string"), pattern=("'E'", "string")),
        "p7_cmp_ok_sample": _sample_sql("lineitem", "l_returnflag", "l_linenumber > 3", "l_orderkey, l_linenumber", have=("CAST(l_linenumber AS VARCHAR)", "int"), operator=("'<='", "string"), want=("'3'", "int")),
        "p8_isa_ok_sample": _sample_sql("events", "event_type", "coalesce(json_type(props, '$.k'), '') <> 'VARCHAR'", "event_id", have=("CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN 'BIGINT' ELSE json_type(props, '$.k') END", "string"), want=("'STRING'", "string")),
        "p9_describe": """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus IS NULL THEN 'null' ELSE '"' || o_orderstatus || '"' END AS status_json, o_orderstatus AS status_display, 'double' AS price_type, o_totalprice IS NULL AS price_is_null FROM {orders_expected}""",
        "p_check_all": " UNION ALL ".join(f"SELECT l_returnflag, '{n}' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT coalesce({p}, false)) AS failures, count(*) FILTER (WHERE NOT coalesce({p}, false)) = 0 AS passed FROM {{lineitem}} GROUP BY l_returnflag" for n, p in (("discount", "l_discount <= 0.05"), ("quantity", "l_quantity > 1"), ("tax", "l_tax < 1"))),
        "k1_col_not_null": f"SELECT \"column\", rows, nulls, coalesce(nulls = 0, false) AS passed, CASE WHEN nulls IS NULL THEN 'missing_object' WHEN nulls > 0 THEN 'column_property' END AS failure_kind FROM ({_NULLS}) x",
        "k1_col_is_null": f"SELECT \"column\", rows, nulls, coalesce(nulls > 0, false) AS passed, CASE WHEN nulls IS NULL THEN 'missing_object' WHEN nulls = 0 THEN 'column_property' END AS failure_kind FROM ({_NULLS}) x",
        "k2_col_type_is": """SELECT c AS "column", t AS want_type, rows, failures, coalesce(failures = 0, false) AS passed, coalesce(k, CASE WHEN failures > 0 THEN 'column_property' END) AS failure_kind FROM (
            SELECT 'p_brand' AS c, 'string' AS t, count(*) AS rows, count(*) FILTER (WHERE length(p_brand) > 8) AS failures, NULL AS k FROM {part}
            UNION ALL SELECT 'p_size', 'smallint', count(*), count(*) FILTER (WHERE TRY_CAST(p_size AS SMALLINT) IS NULL), NULL FROM {part}
            UNION ALL SELECT 'p_name', 'double', count(*), count(*) FILTER (WHERE TRY_CAST(p_name AS DOUBLE) IS NULL), NULL FROM {part}
            UNION ALL SELECT 'p_name', NULL, count(*), NULL, 'invalid_expected' FROM {part}
            UNION ALL SELECT 'p_comment', 'string', count(*), NULL, 'missing_object' FROM {part}) x""",
        "k3_col_has_default": _dominant("orders_expected", "o_orderstatus") + ", n >= 0.3 * rows AS passed FROM t",
        "k3_col_hasnt_default": _dominant("events", "event_type") + ", NOT n >= 0.5 * rows AS passed FROM t",
        "k3_col_default_is": """WITH c AS (SELECT event_type AS v, count(*) AS n FROM {events} GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS rows, max(n) AS n FROM c), m AS (SELECT rows, n, (SELECT max(v) FROM c WHERE c.n = t.n) AS v FROM t)
            SELECT 'event_type' AS "column", rows, CASE WHEN n >= 0.1 * rows THEN v END AS value, n >= 0.1 * rows AND v = 'view' AS passed, CASE WHEN NOT (n >= 0.1 * rows AND v = 'view') THEN 'column_property' END AS failure_kind FROM m
            UNION ALL SELECT 'flag', rows, '7', true, NULL FROM m
            UNION ALL SELECT 'user_id', rows, NULL, false, 'invalid_expected' FROM m""",
        "k4_has_pk": "WITH g AS (SELECT count(*) AS n, l_orderkey IS NULL OR l_linenumber IS NULL AS u FROM {lineitem} GROUP BY l_orderkey, l_linenumber) SELECT 'l_orderkey,l_linenumber' AS key, count(*) FILTER (WHERE NOT u AND n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (WHERE u), 0) AS BIGINT) AS null_rows, count(*) FILTER (WHERE u OR n > 1) = 0 AS passed FROM g",
        "k4_col_is_pk": "WITH g AS (SELECT count(*) AS n, o_orderkey IS NULL AS u FROM {orders} GROUP BY o_orderkey) SELECT 'o_orderkey' AS key, count(*) FILTER (WHERE NOT u AND n > 1) AS duplicate_keys, CAST(coalesce(sum(n) FILTER (WHERE u), 0) AS BIGINT) AS null_rows, count(*) FILTER (WHERE u OR n > 1) = 0 AS passed FROM g",
        "k5_has_field": "SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE json_exists(props, '$.k')) AS present, count(*) FILTER (WHERE json_exists(props, '$.k')) / count(*) AS rate, count(*) FILTER (WHERE json_exists(props, '$.k')) = count(*) AS passed FROM {events} GROUP BY event_type",
        "k5_hasnt_field": "SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE json_exists(props, '$.missing')) AS present, count(*) FILTER (WHERE json_exists(props, '$.missing')) / count(*) AS rate, count(*) FILTER (WHERE json_exists(props, '$.missing')) = 0 AS passed FROM {events} GROUP BY event_type",
        "k6_accepted_values": """WITH w(v) AS (VALUES ('view'), ('click'), ('signup'), ('refund')), h AS (SELECT DISTINCT event_type AS v FROM {events}),
            m AS (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') AS s FROM w WHERE v NOT IN (SELECT v FROM h)), x AS (SELECT coalesce(string_agg(v, ',' ORDER BY v), '') AS s FROM h WHERE v NOT IN (SELECT v FROM w))
            SELECT 'event_type' AS "column", m.s = '' AND x.s = '' AS passed, m.s AS missing, x.s AS unexpected FROM m, x""",
        "k7_domain_ok": "SELECT 'l_discount' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE l_discount IS NOT NULL AND TRY_CAST(l_discount AS DECIMAL(4,2)) IS NULL) AS uncastable, count(*) FILTER (WHERE NOT coalesce(l_discount < 0.1, false)) AS refused, count(*) FILTER (WHERE NOT coalesce(l_discount < 0.1, false)) = 0 AS passed FROM {lineitem}",
        "k8_validate_unique": "SELECT 'p_name,p_brand' AS key, count(*) AS duplicate_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_conflict, count(*) = 0 AS passed FROM (SELECT count(*) AS n FROM {part} WHERE p_name IS NOT NULL AND p_brand IS NOT NULL GROUP BY p_name, p_brand HAVING count(*) > 1) g",
        "k9_validate_foreign_key": "SELECT count(DISTINCT doc_id) AS unresolved_keys, count(*) AS unresolved_rows, count(*) = 0 AS passed FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels})",
        "k9_lineitem_orders": "SELECT count(DISTINCT l_orderkey) AS unresolved_keys, count(*) AS unresolved_rows, count(*) = 0 AS passed FROM {lineitem} l WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_orderkey = l_orderkey)",
        "k10_validate_check": "SELECT count(*) AS rows, count(*) FILTER (WHERE NOT o_totalprice > 1000) AS failures, count(*) FILTER (WHERE NOT o_totalprice > 1000) = 0 AS passed FROM {orders_expected}",
        "k11_exclusion_of_one_key": "SELECT CAST(0 AS INTEGER) AS k, id, start_ts, end_ts FROM (SELECT *, max(end_ts) OVER (ORDER BY start_ts, end_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {spans}) t WHERE start_ts < reach",
        "k11_validate_exclusion": "SELECT k, id, start_ts, end_ts FROM (SELECT *, max(end_ts) OVER (PARTITION BY k ORDER BY start_ts, end_ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {spans}) t WHERE start_ts < reach",
    }.items()
}

"""Registered queries over the comparison operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relations as R
from ..operators.keyed import keyed_diff
from .fixtures import oracle, table

FLAT = ["kind", "passed", "missing_count", "extra_count"]


def _pair(spark, d):
    return table(spark, d, "orders"), table(spark, d, "orders_expected")


def _counts(f):
    return lambda spark, d: f(*_pair(spark, d), samples=False).select(*FLAT)


def _keyed(diff):
    return diff.withColumn("changed_columns", F.array_join("changed_columns", ","))


QUERIES = {
    "s1_materialise": lambda spark, d: R.materialise(table(spark, d, "events").where("event_type = 'error'")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top")),
    "s2_relation_of": lambda spark, d: R.set_has(table(spark, d, "events").select("event_type"), R.relation_of(spark, ["view", "click", "refund"]), samples=False).select(*FLAT),
    "s3_with_position": lambda spark, d: R.with_position(table(spark, d, "orders_expected").select("o_orderdate", "o_orderkey", "o_totalprice"), ["o_orderdate"]),
    "c1_set_difference": lambda spark, d: R.set_difference(*_pair(spark, d)),
    "c2_bag_difference": lambda spark, d: R.bag_difference(*reversed(_pair(spark, d))),
    "c3_set_eq": _counts(R.set_eq),
    "c4_bag_eq": _counts(R.bag_eq),
    "c5_set_has": _counts(R.set_has),
    "c6_bag_has": _counts(R.bag_has),
    "c7_set_ne": lambda spark, d: R.set_ne(*_pair(spark, d)).select(*FLAT),
    "c8_results_eq": lambda spark, d: R.results_eq(*_pair(spark, d), order_by=["o_orderkey"]).select("kind", "passed", "have_rows", "want_rows", "first_difference_at"),
    "c9_is_empty": lambda spark, d: R.is_empty(table(spark, d, "orders_expected").where("o_totalprice IS NULL")).select("kind", "passed", "row_count"),
    "c10_isnt_empty": lambda spark, d: R.isnt_empty(table(spark, d, "orders_expected").where("o_totalprice IS NULL")).select("kind", "passed"),
    "c11_comparable": lambda spark, d: R.comparable(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "orders_expected").select("o_orderkey", "o_orderstatus")).select("kind", "passed", "have_rows", "want_rows", F.size("have_columns").alias("have_arity"), F.element_at("want_columns", 2)["type"].alias("want_type")),
    "c12_diff_sample": lambda spark, d: R.set_eq(*(x.select("o_orderkey", "o_orderstatus") for x in _pair(spark, d))).select("kind", "truncated", "sample_limit", F.explode("missing_sample").alias("row")),
    "c13_keyed_diff": lambda spark, d: _keyed(keyed_diff(*_pair(spark, d), keys=["o_orderkey", "o_custkey"])),
    "c13_keyed_diff_bags": lambda spark, d: _keyed(keyed_diff(*_pair(spark, d), keys=["o_custkey"], most_rows=20)),
}

_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_SIGNED = f"""WITH s AS (SELECT {_COLUMNS}, sum(h) AS h, sum(w) AS w FROM (
    SELECT {_COLUMNS}, 1 AS h, 0 AS w FROM {{orders}} UNION ALL SELECT {_COLUMNS}, 0, 1 FROM {{orders_expected}}) u GROUP BY ALL)"""


def _signed(kind: str, missing: str, extra: str, passed: str = "coalesce(sum({m}), 0) = 0 AND coalesce(sum({x}), 0) = 0") -> str:
    return f"{_SIGNED} SELECT '{kind}' AS kind, {passed.format(m=missing, x=extra)} AS passed, CAST(coalesce(sum({missing}), 0) AS BIGINT) AS missing_count, CAST(coalesce(sum({extra}), 0) AS BIGINT) AS extra_count FROM s"


_SET = ("CASE WHEN h = 0 THEN 1 ELSE 0 END", "CASE WHEN w = 0 THEN 1 ELSE 0 END")
_BAG = ("greatest(w - h, 0)", "greatest(h - w, 0)")
_POSITION = f"row_number() OVER (ORDER BY o_orderkey NULLS FIRST, o_custkey NULLS FIRST, o_orderstatus NULLS FIRST, o_totalprice NULLS FIRST, o_orderdate NULLS FIRST, o_orderpriority NULLS FIRST) AS position, {_COLUMNS}"
_DIFFERS = " OR ".join(f"h.{c} IS DISTINCT FROM w.{c}" for c in _COLUMNS.split(", "))



def _keyed_sql(keys: list[str]) -> str:
    """Surplus copies of each side, one row a copy, numbered within the key and paired by number."""
    key, others = ", ".join(keys), [c for c in _COLUMNS.split(", ") if c not in keys]
    order = ", ".join(f"{c} NULLS FIRST" for c in others)
    side = lambda n: f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS place FROM s, unnest(range(1, CAST(greatest({n}, 0) + 1 AS BIGINT))) t(copy))"
    named = ", ".join(f"CASE WHEN h.{c} IS DISTINCT FROM w.{c} THEN '{c}' END" for c in others)
    both = "h.place IS NOT NULL AND w.place IS NOT NULL"
    return f"""{_SIGNED}, p AS (SELECT {", ".join(f"coalesce(h.{c}, w.{c}) AS {c}" for c in keys)}, CASE WHEN h.place IS NULL THEN 'missing' WHEN w.place IS NULL THEN 'extra' ELSE 'changed' END AS status,
            CASE WHEN {both} THEN concat_ws(',', {named}) ELSE '' END AS changed_columns FROM {side("h - w")} h FULL JOIN {side("w - h")} w ON h.place = w.place AND {" AND ".join(f"h.{c} = w.{c}" for c in keys)})
        SELECT {key}, status, changed_columns, count(*) AS copies FROM p GROUP BY ALL"""


ORACLE = {
    k: oracle(v)
    for k, v in {
        "s1_materialise": "SELECT user_id, count(*) AS n, max(value) AS top FROM {events} WHERE event_type = 'error' GROUP BY user_id",
        "s2_relation_of": "SELECT 'set_has' AS kind, count(*) = 0 AS passed, count(*) AS missing_count, CAST(0 AS BIGINT) AS extra_count FROM (SELECT v FROM (VALUES ('view'), ('click'), ('refund')) t(v) EXCEPT SELECT event_type FROM {events}) m",
        "s3_with_position": "SELECT o_orderdate, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate NULLS FIRST, o_orderkey NULLS FIRST, o_totalprice NULLS FIRST) AS position FROM {orders_expected}",
        "c1_set_difference": f"SELECT {_COLUMNS} FROM {{orders}} EXCEPT SELECT {_COLUMNS} FROM {{orders_expected}}",
        "c2_bag_difference": f"SELECT {_COLUMNS} FROM {{orders_expected}} EXCEPT ALL SELECT {_COLUMNS} FROM {{orders}}",
        "c3_set_eq": _signed("set_eq", *_SET),
        "c4_bag_eq": _signed("bag_eq", *_BAG),
        "c5_set_has": _signed("set_has", _SET[0], "0"),
        "c6_bag_has": _signed("bag_has", _BAG[0], "0"),
        "c7_set_ne": _signed("set_ne", *_SET, passed="NOT (coalesce(sum({m}), 0) = 0 AND coalesce(sum({x}), 0) = 0)"),
        "c8_results_eq": f"""WITH h AS (SELECT {_POSITION} FROM {{orders}}), w AS (SELECT {_POSITION} FROM {{orders_expected}}),
            f AS (SELECT count(h.position) AS have_rows, count(w.position) AS want_rows, min(CASE WHEN h.position IS NOT NULL AND w.position IS NOT NULL AND ({_DIFFERS}) THEN h.position END) AS bad FROM h FULL JOIN w ON h.position = w.position)
            SELECT 'results_eq' AS kind, coalesce(bad, CASE WHEN have_rows <> want_rows THEN 0 END) IS NULL AS passed, have_rows, want_rows, coalesce(bad, CASE WHEN have_rows <> want_rows THEN least(have_rows, want_rows) + 1 END) AS first_difference_at FROM f""",
        "c9_is_empty": "SELECT 'is_empty' AS kind, count(*) = 0 AS passed, count(*) AS row_count FROM {orders_expected} WHERE o_totalprice IS NULL",
        "c10_isnt_empty": "SELECT 'isnt_empty' AS kind, count(*) > 0 AS passed FROM {orders_expected} WHERE o_totalprice IS NULL",
        "c11_comparable": "SELECT 'comparable' AS kind, false AS passed, (SELECT count(*) FROM {orders}) AS have_rows, (SELECT count(*) FROM {orders_expected}) AS want_rows, CAST(2 AS INTEGER) AS have_arity, 'string' AS want_type",
        "c12_diff_sample": """WITH m AS (SELECT DISTINCT w.o_orderkey, w.o_orderstatus FROM {orders_expected} w WHERE NOT EXISTS (SELECT 1 FROM {orders} h WHERE h.o_orderkey = w.o_orderkey AND h.o_orderstatus IS NOT DISTINCT FROM w.o_orderstatus)),
            x AS (SELECT count(*) AS n FROM (SELECT o_orderkey, o_orderstatus FROM {orders} EXCEPT SELECT o_orderkey, o_orderstatus FROM {orders_expected}) e)
            SELECT 'set_eq' AS kind, (SELECT count(*) FROM m) > 20 OR (SELECT n FROM x) > 20 AS truncated, CAST(20 AS INTEGER) AS sample_limit, '["' || o_orderkey || '","' || o_orderstatus || '"]' AS row FROM (SELECT * FROM m ORDER BY o_orderkey, o_orderstatus LIMIT 20) t""",
        "c13_keyed_diff": _keyed_sql(["o_orderkey", "o_custkey"]),
        "c13_keyed_diff_bags": _keyed_sql(["o_custkey"]),
    }.items()
}

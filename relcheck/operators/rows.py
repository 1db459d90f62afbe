"""Predicates over every row of a table.

Each returns, for the whole table or for each group of `by`, kind, rows, failures and passed. A
predicate that is null fails. Several rules on one table are one pass with `check_all`. With `evidence=n` a check
has a column `sample` besides: up to n failing rows of each group (see failing_sample), with the values that were compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The operators that cmp_ok accepts.
OPERATORS = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<=>": lambda a, b: a.eqNullSafe(b),
}


#: Failing rows that a check's sample has for each group.
SAMPLE_ROWS = 20


def failing_sample(df: DataFrame, predicate: Column, show: dict[str, Column], by: list[str] | None = None, identity: list[str] | None = None, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(by, sample) of the groups with failing rows: `limit` of these at most, each a struct of described values (P9), one for each of show.

    The rows are those with the least MD5 of their identity (all columns unless named, joined by `|`), so the sample does
    not depend on how rows are dealt and grows by no group's size: ranks are limited within tasks before the shuffle. Ties go by the values.
    """
    by = by or []
    kinds = dict(df.select(*(c.alias(n) for n, c in show.items())).dtypes)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("row key", "values"))
    key = F.md5(F.concat_ws("|", *(F.col(f"`{c}`").cast("string") for c in identity or df.columns)))
    values = F.struct(*(describe(c, kinds[n]).alias(n) for n, c in show.items()))
    failing = df.where(~F.coalesce(predicate, F.lit(False))).select(*by, key.alias("row key"), values.alias("values"))
    first = failing.withColumn("place", place).where(F.col("place") <= limit)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "values"))), lambda x: x["values"]).alias("sample"))


def _check(df: DataFrame, kind: str, predicate: Column, by: list[str] | None, show: dict[str, Column], evidence: int, identity: list[str] | None) -> DataFrame:
    by = by or []
    failed = ~F.coalesce(predicate, F.lit(False))
    grouped = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(failed).alias("failures"))
    out = grouped.select(*by, F.lit(kind).alias("kind"), "rows", "failures", (F.col("failures") == 0).alias("passed"))
    if not evidence:
        return out
    group = F.struct(F.lit(1).alias("one"), *by)
    sample = failing_sample(df, predicate, show, by, identity, evidence).select(group.alias("sampled group"), "sample")
    met = out.join(sample, group.eqNullSafe(F.col("sampled group")), "left")
    return met.select(*out.columns, F.coalesce("sample", F.array().cast(sample.schema["sample"].dataType)).alias("sample"))


def check_all(df: DataFrame, rules: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """All rules (name to predicate) in one aggregate: one row a rule, or a rule and group."""
    names = list(rules)
    counts = [F.count_if(~F.coalesce(p, F.lit(False))).alias(f"__r{i}") for i, p in enumerate(rules.values())]
    grouped = df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), *counts)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"__r{i}").alias("failures")) for i, n in enumerate(names))))
    return grouped.select(*(by or []), "rows", each.alias("r")).select(*(by or []), "r.rule", "rows", "r.failures", (F.col("r.failures") == 0).alias("passed"))


def failing_rows(df: DataFrame, predicate: Column, limit: int = 20) -> DataFrame:
    """A sample of rows that fail, in the order of all columns."""
    return df.where(~F.coalesce(predicate, F.lit(False))).orderBy(*df.columns).limit(limit)


def ok(df: DataFrame, predicate: Column, by: list[str] | None = None, evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """The predicate holds."""
    return _check(df, "ok", predicate, by, {"have": predicate}, evidence, identity)


def is_equal(df: DataFrame, have: Column, want: Column, by: list[str] | None = None, evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """Null-safe equality."""
    return _check(df, "is", have.eqNullSafe(want), by, {"have": have, "want": want}, evidence, identity)


def isnt_equal(df: DataFrame, have: Column, unwanted: Column, by: list[str] | None = None, evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """Null-safe inequality."""
    return _check(df, "isnt", ~have.eqNullSafe(unwanted), by, {"have": have, "unwanted": unwanted}, evidence, identity)


def matches(df: DataFrame, column: Column, pattern: str, by: list[str] | None = None, evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """The pattern is found in the value's text (Java syntax)."""
    return _check(df, "matches", column.cast("string").rlike(pattern), by, {"have": column, "pattern": F.lit(pattern)}, evidence, identity)


def imatches(df: DataFrame, column: Column, pattern: str, by: list[str] | None = None, evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """P5: as matches, in any case."""
    return _check(df, "imatches", column.cast("string").rlike("(?i)" + pattern), by, {"have": column, "pattern": F.lit(pattern)}, evidence, identity)


def doesnt_match(df: DataFrame, column: Column, pattern: str, by: list[str] | None = None, evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """The pattern is not found; null fails."""
    return _check(df, "doesnt_match", ~column.cast("string").rlike(pattern), by, {"have": column, "pattern": F.lit(pattern)}, evidence, identity)


def cmp_ok(df: DataFrame, have: Column, operator: str, want: Column, by: list[str] | None = None, evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """Compared by an operator named at run time, one of OPERATORS."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(OPERATORS)}")
    return _check(df, "cmp_ok", OPERATORS[operator](have, want), by, {"have": have, "operator": F.lit(operator), "want": want}, evidence, identity)


def isa_ok(df: DataFrame, json: Column, kind: str, by: list[str] | None = None, field: str = "$", evidence: int = 0, identity: list[str] | None = None) -> DataFrame:
    """The JSON value at `field` has the type (BIGINT, DOUBLE, STRING, BOOLEAN, ARRAY..., OBJECT...)."""
    value = F.try_variant_get(F.try_parse_json(json), field, "variant")
    found = F.schema_of_variant(value)
    number = F.when(found.startswith("DECIMAL"), F.lit("DOUBLE")).otherwise(found)
    return _check(df, "isa_ok", F.upper(number).startswith(kind.upper()), by, {"have": number, "want": F.lit(kind.upper())}, evidence, identity)


def describe(column: Column, kind: str) -> Column:
    """struct(json, display, type, is_null); null and empty text stay apart."""
    json = F.when(column.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
    return F.struct(json.alias("json"), column.cast("string").alias("display"), F.lit(kind).alias("type"), column.isNull().alias("is_null"))

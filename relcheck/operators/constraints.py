"""Column, key and constraint rules measured on data.

failure_kind keeps apart what went wrong: missing_object (no such column), invalid_expected (the
expectation can't be used) and column_property (the data don't have the property).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scans import MOST_ROWS, dealt, running


def _nulls(df: DataFrame, columns: list[str], want_null: bool) -> DataFrame:
    have = [c for c in columns if c in df.columns]
    facts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(have)))
    each = [F.struct(F.lit(c).alias("column"), (F.col(f"__n{have.index(c)}") if c in have else F.lit(None).cast("bigint")).alias("nulls")) for c in columns]
    rows = facts.select("rows", F.explode(F.array(*each)).alias("e")).select("e.column", "rows", "e.nulls")
    holds = F.col("nulls") > 0 if want_null else F.col("nulls") == 0
    kind = F.when(F.col("nulls").isNull(), F.lit("missing_object")).when(~holds, F.lit("column_property"))
    return rows.select("column", "rows", "nulls", F.coalesce(holds, F.lit(False)).alias("passed"), kind.alias("failure_kind"))


def col_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """K1: no nulls, for each of the columns, in one pass."""
    return _nulls(df, columns, False)


def col_is_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """K1: nulls occur."""
    return _nulls(df, columns, True)


# Other spellings of types.
_SPELLINGS = {"character varying": "string", "varchar": "string", "text": "string", "character": "string", "char": "string", "double precision": "double", "float8": "double", "real": "float", "integer": "int", "int4": "int", "int8": "bigint", "int2": "smallint", "numeric": "decimal(38,18)", "bool": "boolean", "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "timestamp without time zone": "timestamp_ntz", "bytea": "binary"}


def normalise_type(df: DataFrame, name: str) -> tuple[str | None, int | None]:
    """The type's one spelling and its length limit, if it has one; (None, None) for an unknown type."""
    import re

    m = re.fullmatch(r"\s*([a-z_ 0-9]+?)\s*(?:\(\s*(\d+)\s*\))?\s*", name.lower())
    limit = int(m[2]) if m and m[2] and "char" in m[1] else None
    plain = _SPELLINGS.get(m[1], name if not limit else m[1]) if m else name
    try:
        return df.sparkSession.range(0).select(F.lit(None).cast(plain).alias("x")).schema["x"].dataType.simpleString(), limit
    except Exception:  # the SQL type parser's own refusal, whatever its class
        return None, None


def col_type_is(df: DataFrame, column: str, kind: str) -> DataFrame:
    """K2: every value, as text, conforms to the type; nulls conform."""
    wanted, limit = normalise_type(df, kind)
    head = [F.lit(column).alias("column"), F.lit(wanted).cast("string").alias("want_type")]
    none = F.lit(None).cast("bigint")
    if column not in df.columns or wanted is None:
        failure = "missing_object" if column not in df.columns else "invalid_expected"
        return df.agg(F.count("*").alias("rows")).select(*head, "rows", none.alias("failures"), F.lit(False).alias("passed"), F.lit(failure).alias("failure_kind"))
    c = F.col(column)
    bad = c.isNotNull() & c.cast("string").try_cast(wanted).isNull()
    if limit is not None:
        bad = bad | (F.length(c.cast("string")) > limit)
    facts = df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("failures"))
    return facts.select(*head, "rows", "failures", (F.col("failures") == 0).alias("passed"), F.when(F.col("failures") > 0, F.lit("column_property")).alias("failure_kind"))


def _dominant(df: DataFrame, column: str, share: float) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    top = counts.agg(F.sum("n").alias("rows"), F.max_by("v", F.struct("n", F.col("v").cast("string"))).alias("value"), F.max("n").alias("n"))
    return top.select("rows", "value", "n", F.coalesce(F.col("n") >= share * F.col("rows"), F.lit(False)).alias("dominates"))


def col_has_default(df: DataFrame, column: str, share: float = 0.5) -> DataFrame:
    """K3: one fill-in value stands in `share` of the rows or more; ties go to the largest value."""
    return _dominant(df, column, share).select(F.lit(column).alias("column"), "rows", F.col("value").cast("string").alias("value"), "n", F.col("dominates").alias("passed"))


def col_hasnt_default(df: DataFrame, column: str, share: float = 0.5) -> DataFrame:
    """K3: no value stands in `share` of the rows."""
    return _dominant(df, column, share).select(F.lit(column).alias("column"), "rows", F.col("value").cast("string").alias("value"), "n", (~F.col("dominates")).alias("passed"))


def col_default_is(df: DataFrame, column: str, expected, share: float = 0.5) -> DataFrame:
    """K3: the dominant value equals the expected one, null-safe.

    failure_kind: column_property without a dominant value or with another one (value tells), and
    invalid_expected if the expectation can't be cast to the column's type.
    """
    kind = df.schema[column].dataType
    want = F.lit(None).cast(kind) if expected is None else F.lit(str(expected)).try_cast(kind)
    unusable = F.lit(False) if expected is None else want.isNull()
    passed = ~unusable & F.col("dominates") & F.col("value").eqNullSafe(want)
    failure = F.when(unusable, F.lit("invalid_expected")).when(~passed, F.lit("column_property"))
    return _dominant(df, column, share).select(F.lit(column).alias("column"), "rows", F.when(F.col("dominates"), F.col("value").cast("string")).alias("value"), passed.alias("passed"), failure.alias("failure_kind"))


def col_is_pk(df: DataFrame, columns: list[str]) -> DataFrame:
    """K4: unique and never null; the key's columns are reported in the order given."""
    null = F.lit(False)
    for c in columns:
        null = null | F.col(c).isNull()
    groups = df.groupBy(*columns).agg(F.count("*").alias("n")).select("n", null.alias("null"))
    facts = groups.agg(F.count_if(~F.col("null") & (F.col("n") > 1)).alias("duplicate_keys"), F.coalesce(F.sum(F.when(F.col("null"), F.col("n"))), F.lit(0)).alias("null_rows"))
    return facts.select(F.lit(",".join(columns)).alias("key"), "duplicate_keys", "null_rows", ((F.col("duplicate_keys") == 0) & (F.col("null_rows") == 0)).alias("passed"))


has_pk = col_is_pk


def has_field(df: DataFrame, json: str, field: str, by: list[str] | None = None, want: bool = True) -> DataFrame:
    """K5: share of rows whose JSON object has the field (value null or not), a group at a time."""
    has = F.coalesce(F.array_contains(F.json_object_keys(json), field), F.lit(False))
    facts = df.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.count_if(has).alias("present"))
    good = F.col("present") == F.col("rows") if want else F.col("present") == 0
    return facts.select(*(by or []), "rows", "present", (F.col("present") / F.col("rows")).alias("rate"), good.alias("passed"))


def hasnt_field(df: DataFrame, json: str, field: str, by: list[str] | None = None) -> DataFrame:
    """K5: no row has the field."""
    return has_field(df, json, field, by, want=False)


def accepted_values(df: DataFrame, column: str, labels: list[str], ordinal: str | None = None, most_listed: int = 1000) -> DataFrame:
    """K6: the labels that occur are the expected ones; missing and unexpected are listed.

    With an ordinal column the labels' order (by their least ordinal) must be the expected one too. Of the
    labels that occur the expected ones and the first `most_listed` are listed; the verdict is about all: where
    more occur than are expected, one of the first is unexpected.
    """
    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg((F.min(ordinal) if ordinal else F.lit(0)).alias("at"))
    first = seen.orderBy("at", "label").limit(max(most_listed, len(labels) + 1))
    seen = first.union(seen.where(F.col("label").isin(labels))).distinct()
    want = F.array(*map(F.lit, labels)) if labels else F.array().cast("array<string>")
    order = F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda x: x["label"])
    facts = seen.agg(order.alias("have")).select("have", F.array_sort(F.array_except(want, "have")).alias("missing"), F.array_sort(F.array_except("have", want)).alias("unexpected"))
    same = (F.size("missing") == 0) & (F.size("unexpected") == 0)
    return facts.select(F.lit(column).alias("column"), "have", "missing", "unexpected", (same & (F.col("have") == want) if ordinal else same).alias("passed"))


def domain_ok(df: DataFrame, column: str, base_type: str, check: Column | None = None) -> DataFrame:
    """K7: values cast to the base type and satisfy the check; a null check fails."""
    c = F.col(column)
    uncastable = c.isNotNull() & c.try_cast(base_type).isNull()
    refused = ~F.coalesce(check, F.lit(False)) if check is not None else F.lit(False)
    facts = df.agg(F.count("*").alias("rows"), F.count_if(uncastable).alias("uncastable"), F.count_if(~uncastable & refused).alias("refused"))
    return facts.select(F.lit(column).alias("column"), "rows", "uncastable", "refused", ((F.col("uncastable") == 0) & (F.col("refused") == 0)).alias("passed"))


def validate_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """K8: UNIQUE: rows with a null in the key never conflict."""
    groups = df.select(*columns).dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    facts = groups.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_conflict"))
    return facts.select(F.lit(",".join(columns)).alias("key"), "duplicate_keys", "rows_in_conflict", (F.col("duplicate_keys") == 0).alias("passed"))


def validate_foreign_key(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """K9: child columns refer to parent columns; a reference with a null is valid."""
    keys = child.select(*on).dropna().groupBy(*on).agg(F.count("*").alias("n"))
    condition = [keys[c] == parent[p] for c, p in on.items()]
    lost = keys.join(parent.select(*on.values()), condition, "left_anti")
    facts = lost.agg(F.count("*").alias("unresolved_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("unresolved_rows"))
    return facts.select("unresolved_keys", "unresolved_rows", (F.col("unresolved_rows") == 0).alias("passed"))


def validate_check(df: DataFrame, predicate: Column) -> DataFrame:
    """CHECK: fails only where the predicate is false; null passes."""
    facts = df.agg(F.count("*").alias("rows"), F.count_if(~predicate).alias("failures"))
    return facts.select("rows", "failures", (F.col("failures") == 0).alias("passed"))


def validate_exclusion(df: DataFrame, key: str, start: str, end: str, identity: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows whose range [start, end) overlaps an earlier one of their key, by sorting; no self-join.

    Rows with a null key or bound, or an empty range, overlap nothing. A key of more than `most_rows` rows is dealt over tasks.
    """
    rows = df.dropna(subset=[key, start, end]).where(F.col(start) < F.col(end)).select(key, identity, start, end)
    order = [start, end, identity]
    return running(dealt(rows, [key], order, most_rows), [key], order, __reach=("reach", F.col(end))).where(F.col(start) < F.col("__reach")).select(key, identity, start, end)

"""Captured failures and timings.

attempts: key columns and, where the attempt failed, sqlstate and message (null where it completed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_STATE = "^[0-9A-Z]{5}$"


def _judged(attempts: DataFrame, kind: str, matched: Column, expected: Column) -> DataFrame:
    raised = F.col("sqlstate").isNotNull()
    caught = F.when(raised, F.concat_ws(": ", "sqlstate", "message")).otherwise(F.lit("completed without raising"))
    return attempts.withColumns({"kind": F.lit(kind), "passed": raised & F.coalesce(matched, F.lit(False)), "expected": expected.cast("string"), "caught": caught})


def throws_ok(attempts: DataFrame, sqlstate: str | None = None, message: str | None = None) -> DataFrame:
    """failed with exactly this code and message; None stands for anything."""
    matched = F.lit(True)
    if sqlstate is not None:
        matched = matched & (F.col("sqlstate") == sqlstate)
    if message is not None:
        matched = matched & (F.col("message") == message)
    return _judged(attempts, "throws_ok", matched, F.concat_ws(": ", F.lit(sqlstate or "any"), F.lit(message)))


def looks_like_sqlstate(c: Column) -> Column:
    return c.rlike(_STATE)


def throws_sqlstate(attempts: DataFrame, code: str, description: str | None = None) -> DataFrame:
    """failed with this code. A code that is none, or a description that looks like one, is refused."""
    import re

    if not re.fullmatch(_STATE.strip("^$"), code):
        raise ValueError(f"{code!r} is no SQLSTATE")
    if description is not None and re.fullmatch(_STATE.strip("^$"), description):
        raise ValueError(f"the description {description!r} looks like a SQLSTATE")
    return _judged(attempts, "throws_sqlstate", F.col("sqlstate") == code, F.lit(code))


def throws_like(attempts: DataFrame, pattern: str) -> DataFrame:
    """failed with a message LIKE the pattern."""
    return _judged(attempts, "throws_like", F.col("message").like(pattern), F.lit(pattern))


def throws_ilike(attempts: DataFrame, pattern: str) -> DataFrame:
    """as throws_like, in any case."""
    return _judged(attempts, "throws_ilike", F.col("message").ilike(pattern), F.lit(pattern))


def throws_matching(attempts: DataFrame, pattern: str) -> DataFrame:
    """failed with a message in which the pattern is found."""
    return _judged(attempts, "throws_matching", F.col("message").rlike(pattern), F.lit(pattern))


def lives_ok(df: DataFrame, tried: Column, inputs: list[Column], sqlstate: str) -> DataFrame:
    """adds lives and, where the expression would raise, its error class.

    `tried` is the expression's try_ form: null although no input is null means that the plain form raises.
    """
    given = F.lit(True)
    for c in inputs:
        given = given & c.isNotNull()
    raises = given & tried.isNull()
    return df.withColumns({"lives": ~raises, "sqlstate": F.when(raises, F.lit(sqlstate))})


def performs_ok(timings: DataFrame, duration: str, budget_ms: float, by: list[str]) -> DataFrame:
    """every timing of a group is strictly under the budget; the largest is reported, rounded to 3 decimals."""
    facts = timings.groupBy(*by).agg(F.max(duration).alias("m"))
    return facts.select(*by, F.round("m", 3).alias("observed_ms"), F.coalesce(F.col("m") < budget_ms, F.lit(False)).alias("passed"))


def performs_within(timings: DataFrame, duration: str, expected_ms: float, tolerance_ms: float, by: list[str], order_by: list[str], iterations: int = 10) -> DataFrame:
    """the mean of a group's first timings, one at least, lies within the tolerance of the expected one."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))
    first = timings.withColumn("__nth", nth).where(F.col("__nth") <= max(iterations, 1))
    facts = first.groupBy(*by).agg(F.avg(duration).alias("m"), F.count("*").alias("iterations"))
    return facts.select(*by, "iterations", F.round("m", 3).alias("mean_ms"), F.coalesce(F.abs(F.col("m") - expected_ms) <= tolerance_ms, F.lit(False)).alias("passed"))

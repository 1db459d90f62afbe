"""Running values within each key of a table, in an order, however large one key is.

A window hands all rows of a key to one task. Where a key has more rows than a task should sort, rows
are dealt by range of (key, order) instead: windows run within the parts of a key that lie in each
range, and what the earlier (or later) parts of the key come to is joined to them, as positions are
offset in with_position. Only a key that goes over from one range to the next has such carries, so
they are fewer than the ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .relations import written

#: Rows of a key that one task may sort.
MOST_ROWS = 2_000_000

_PART = "part of the range"


def dealt(df: DataFrame, by: list[str], order: list[str], most_rows: int = MOST_ROWS) -> DataFrame:
    """df, written once and dealt by range of (by, order) if some key has more than `most_rows` rows.

    `order` should tell the rows of a key apart: rows that it doesn't are in one task and in any order.
    """
    largest, rows = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    if (largest or 0) <= most_rows:
        return df
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // most_rows + 1)
    return written(df.repartitionByRange(ranges, *by, *order).withColumn(_PART, F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str], **wanted: tuple[str, Column]) -> DataFrame:
    """df, as dealt() gives it, with a column for each of name=(kind, value).

    sum: of the values up to the row (null counts as 0); last: the last value up to the row that isn't null; reach: the largest
    value before the row; before and next: the value of the row before and after, null values too. Nulls order first.
    """
    apart = _PART in df.columns
    local = Window.partitionBy(*([_PART] if apart else []), *by).orderBy(*order)
    upto, prior = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(*by).orderBy(_PART)
    earlier, later = parts.rowsBetween(Window.unboundedPreceding, -1), parts.rowsBetween(1, Window.unboundedFollowing)
    at, held = F.struct(*order), lambda x: F.struct(x.alias("v"))  # held: a null value is a value
    here = {
        "sum": lambda x: F.coalesce(F.sum(x).over(upto), F.lit(0)),
        "last": lambda x: F.last(x, True).over(upto),
        "reach": lambda x: F.max(x).over(prior),
        "before": lambda x: F.lag(held(x)).over(local),
        "next": lambda x: F.lead(held(x)).over(local),
    }
    out = {name: here[kind](x) for name, (kind, x) in wanted.items()}
    whole_value = lambda kind, name: F.col(name)["v"] if kind in ("before", "next") else F.col(name)
    if not apart:
        return df.withColumns(out).withColumns({name: whole_value(kind, name) for name, (kind, _) in wanted.items()})

    # what a part of a key comes to, and what that means for the parts after it (for next: before it)
    whole = {
        "sum": F.sum, "reach": F.max, "before": lambda x: F.max_by(held(x), at), "next": lambda x: F.min_by(held(x), at),
        "last": lambda x: F.max_by(x, F.when(x.isNotNull(), at)),
    }
    carried = {
        "sum": lambda c: F.sum(c).over(earlier), "reach": lambda c: F.max(c).over(earlier), "last": lambda c: F.last(c, True).over(earlier),
        "before": lambda c: F.last(c, True).over(earlier), "next": lambda c: F.first(c, True).over(later),
    }
    joined = {
        "sum": lambda h, c: h + F.coalesce(c, F.lit(0)), "reach": lambda h, c: F.greatest(h, c), "last": lambda h, c: F.coalesce(h, c),
        "before": lambda h, c: F.coalesce(h, c), "next": lambda h, c: F.coalesce(h, c),
    }
    key = F.struct(*by)
    # a key that has begun in an earlier range is the first of its own: one row a range at most
    over = df.groupBy(_PART).agg(F.min(key).alias("key over")).select("key over").distinct()
    some = df.withColumn("key", key).join(F.broadcast(over), F.col("key").eqNullSafe(F.col("key over")), "left_semi")
    totals = some.groupBy(*by, _PART).agg(*(whole[kind](x).alias(name) for name, (kind, x) in wanted.items()))
    carries = totals.select(key.alias("key over"), F.col(_PART).alias("part over"), *(carried[kind](F.col(name)).alias(f"{name} over") for name, (kind, _) in wanted.items()))
    met = df.withColumns(out).withColumn("key", key).join(F.broadcast(carries), (F.col(_PART) == F.col("part over")) & F.col("key").eqNullSafe(F.col("key over")), "left")
    both = met.withColumns({name: joined[kind](F.col(name), F.col(f"{name} over")) for name, (kind, _) in wanted.items()})
    return both.select(*df.columns, *(whole_value(kind, name).alias(name) for name, (kind, _) in wanted.items()))

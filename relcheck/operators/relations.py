"""Comparison of relations as sets, bags and ordered results.

Every comparison returns one row: kind, passed, description and the evidence columns. Columns are
paired by position, whatever their names, and equality is null-safe.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SAMPLE_LIMIT = 20


def materialise(df: DataFrame) -> DataFrame:
    """Evaluates an input once, so that a volatile one reads the same from then on.

    Written to the checkpoint folder where the session has one, so that it outlives executors; else kept
    in memory and on disk.
    """
    if df.sparkSession.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def written(df: DataFrame) -> DataFrame:
    """df written once to the folder that all machines share and read back; it goes when the driver's JVM ends.

    For loops: unlike checkpoint() this leaves no constraints behind, which double from round to round. The
    folder is spark.checkpoint.dir; a local one is made only where that is unset.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    path = f"{context.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def relation_of(spark: SparkSession, values: list) -> DataFrame:
    """A list of expected values as a relation of one column, `value`."""
    if not values:
        return spark.createDataFrame([], "value string")
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias("value"))


def with_position(df: DataFrame, order_by: list[str], name: str = "position") -> DataFrame:
    """S3: adds the 1-based position in the order of the given columns, the others breaking ties.

    Rows are dealt by range and sorted within partitions; positions are offsets of partitions plus
    places within them, so no task sees all rows.
    """
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in [*order_by, *(c for c in df.columns if c not in order_by)]]
    place = F.monotonically_increasing_id()
    ranged = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", place))
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("__part")).count()
    # one row a partition, however many rows there are
    offsets = sizes.selectExpr("__part", "sum(count) over (order by __part) - count as __offset")
    placed = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, at + F.col("__offset") + 1).drop("__at", "__part", "__offset")


def descriptors(df: DataFrame) -> Column:
    """Column descriptors (position, name, type) as a constant array."""
    return F.array(*(F.struct(F.lit(i + 1).alias("position"), F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for i, f in enumerate(df.schema.fields)))


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return kind.simpleString()


def is_comparable(have: DataFrame, want: DataFrame) -> bool:
    """C11: same arity and, column by column, one type, two numbers or two dates and times."""
    a, b = have.schema.fields, want.schema.fields
    return len(a) == len(b) and all(_family(x.dataType) == _family(y.dataType) or "void" in (x.dataType.simpleString(), y.dataType.simpleString()) for x, y in zip(a, b))


def comparable(have: DataFrame, want: DataFrame) -> DataFrame:
    """C11 as a result row: whether the shapes can be compared, with both sides' descriptors and row counts."""
    one = F.lit(1).alias("__one")
    left, right = have.agg(F.count("*").alias("have_rows")).select(one, "have_rows"), want.agg(F.count("*").alias("want_rows")).select(one, "want_rows")
    both = left.join(F.broadcast(right), "__one")
    return both.select(F.lit("comparable").alias("kind"), F.lit(is_comparable(have, want)).alias("passed"), "have_rows", "want_rows", descriptors(have).alias("have_columns"), descriptors(want).alias("want_columns"))


def _aligned(have: DataFrame, want: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with columns c1, c2, ...; variants as JSON text, since they can't be grouped."""
    names = [f"c{i + 1}" for i in range(len(have.columns))]

    def side(df: DataFrame) -> DataFrame:
        out = df.toDF(*names)
        return out.select(*(F.to_json(c).alias(c) if f.dataType.simpleString() == "variant" else F.col(c) for c, f in zip(names, out.schema.fields)))

    return side(have), side(want), names


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The distinct rows of left that are not in right."""
    a, b, _ = _aligned(left, right)
    return a.subtract(b).toDF(*left.columns)


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left without as many copies of each row as right has."""
    a, b, _ = _aligned(left, right)
    return a.exceptAll(b).toDF(*left.columns)


def _signed(have: DataFrame, want: DataFrame) -> tuple[DataFrame, list[str]]:
    """Each distinct row of either side once, with its copies h and w: one shuffle, combined before it."""
    a, b, names = _aligned(have, want)
    both = a.select("*", F.lit(1).alias("h"), F.lit(0).alias("w")).union(b.select("*", F.lit(0).alias("h"), F.lit(1).alias("w")))
    return both.groupBy(*names).agg(F.sum("h").alias("h"), F.sum("w").alias("w")), names


def diff_sample(diff: DataFrame, limit: int = SAMPLE_LIMIT) -> DataFrame:
    """One row with the first `limit` rows as JSON arrays, in the order of all columns."""
    order = [F.col(f"`{c}`").asc_nulls_first() for c in diff.columns]
    first = diff.orderBy(*order).limit(limit).select(F.to_json(F.array(*(F.col(f"`{c}`").cast("string") for c in diff.columns)), {"ignoreNullFields": "false"}).alias("json"))
    return first.agg(F.sort_array(F.collect_list("json")).alias("sample"))


def _compare(kind: str, have: DataFrame, want: DataFrame, bag: bool, subset: bool, negate: bool, description: str | None, samples: bool) -> DataFrame:
    spark = have.sparkSession
    shapes = [descriptors(have).alias("have_columns"), descriptors(want).alias("want_columns")]
    head = [F.lit(kind).alias("kind")]
    if not is_comparable(have, want):
        none = F.lit(None).cast("bigint")
        row = spark.range(1).select(*head, F.lit(negate).alias("passed"), F.lit(description).cast("string").alias("description"), F.lit(False).alias("comparable"), none.alias("missing_count"), none.alias("extra_count"), *shapes)
        return row
    signed, names = _signed(have, want)
    zero = F.lit(0).cast("bigint")
    if bag:
        missing, extra = F.greatest(F.col("w") - F.col("h"), zero), F.greatest(F.col("h") - F.col("w"), zero)
    else:
        missing, extra = (F.col("h") == 0).cast("bigint"), (F.col("w") == 0).cast("bigint")
    signed = signed.withColumns({"m": missing, "x": zero if subset else extra})
    counts = signed.agg(F.coalesce(F.sum("m"), zero).alias("missing_count"), F.coalesce(F.sum("x"), zero).alias("extra_count"))
    same = (F.col("missing_count") == 0) & (F.col("extra_count") == 0)
    out = counts.select(*head, (~same if negate else same).alias("passed"), F.lit(description).cast("string").alias("description"), F.lit(True).alias("comparable"), "missing_count", "extra_count", *shapes)
    if samples:  # the aggregate's shuffle is read again, not made again
        out = out.withColumn("truncated", (F.col("missing_count") > SAMPLE_LIMIT) | (F.col("extra_count") > SAMPLE_LIMIT)).withColumn("__one", F.lit(1))
        for column, count in (("missing", "m"), ("extra", "x")):
            part = diff_sample(signed.where(F.col(count) > 0).select(*names)).select(F.lit(1).alias("__one"), F.col("sample").alias(f"{column}_sample"))
            out = out.join(F.broadcast(part), "__one")
        out = out.withColumn("sample_limit", F.lit(SAMPLE_LIMIT)).drop("__one")
    return out


def set_eq(have: DataFrame, want: DataFrame, description: str | None = None, samples: bool = True) -> DataFrame:
    """Equal as sets; counts are of distinct rows."""
    return _compare("set_eq", have, want, False, False, False, description, samples)


def bag_eq(have: DataFrame, want: DataFrame, description: str | None = None, samples: bool = True) -> DataFrame:
    """C4: equal as bags; counts are of copies."""
    return _compare("bag_eq", have, want, True, False, False, description, samples)


def set_has(have: DataFrame, want: DataFrame, description: str | None = None, samples: bool = True) -> DataFrame:
    """Have contains every row of want; extra rows are not looked for."""
    return _compare("set_has", have, want, False, True, False, description, samples)


def bag_has(have: DataFrame, want: DataFrame, description: str | None = None, samples: bool = True) -> DataFrame:
    """Have contains every row of want as often as want does."""
    return _compare("bag_has", have, want, True, True, False, description, samples)


def set_ne(have: DataFrame, want: DataFrame, description: str | None = None) -> DataFrame:
    """The sets differ; shapes that can't be compared differ too."""
    return _compare("set_ne", have, want, False, False, True, description, False)


def results_eq(have: DataFrame, want: DataFrame, order_by: list[str], description: str | None = None) -> DataFrame:
    """Equal row by row in the order of `order_by` (columns of have; want's at the same places).

    first_difference_at is the first position where both have rows that differ, else one beyond the
    shorter side, else null.
    """
    head = [F.lit("results_eq").alias("kind")]
    shapes = [descriptors(have).alias("have_columns"), descriptors(want).alias("want_columns")]
    note = F.lit(description).cast("string").alias("description")
    none = F.lit(None).cast("bigint")
    if not is_comparable(have, want):
        return have.sparkSession.range(1).select(*head, F.lit(False).alias("passed"), note, F.lit(False).alias("comparable"), none.alias("have_rows"), none.alias("want_rows"), none.alias("first_difference_at"), *shapes)
    a, b, names = _aligned(have, want)
    keys = [names[have.columns.index(c)] for c in order_by]
    left = with_position(a, keys).select("position", F.struct(*names).alias("h"))
    right = with_position(b, keys).select("position", F.struct(*names).alias("w"))
    both = left.join(right, "position", "full")
    here, there = F.col("h").isNotNull(), F.col("w").isNotNull()
    differs = ~F.forall(F.array(*(F.col(f"h.{c}").eqNullSafe(F.col(f"w.{c}")) for c in names)), lambda x: x)
    facts = both.agg(F.count_if(here).alias("have_rows"), F.count_if(there).alias("want_rows"), F.min(F.when(here & there & differs, F.col("position"))).alias("bad"))
    at = F.coalesce("bad", F.when(F.col("have_rows") != F.col("want_rows"), F.least("have_rows", "want_rows") + 1))
    return facts.select(*head, at.isNull().alias("passed"), note, F.lit(True).alias("comparable"), "have_rows", "want_rows", at.alias("first_difference_at"), *shapes)


def is_empty(df: DataFrame, description: str | None = None) -> DataFrame:
    """No rows; else their count and a sample."""
    df = materialise(df)  # count and sample are of one result
    counted = df.agg(F.count("*").alias("row_count")).withColumn("__one", F.lit(1))
    sample = diff_sample(df).withColumn("__one", F.lit(1))
    return counted.join(F.broadcast(sample), "__one").select(F.lit("is_empty").alias("kind"), (F.col("row_count") == 0).alias("passed"), F.lit(description).cast("string").alias("description"), "row_count", "sample")


def isnt_empty(df: DataFrame, description: str | None = None) -> DataFrame:
    """At least one row; stops at the first."""
    return df.limit(1).agg(F.count("*").alias("n")).select(F.lit("isnt_empty").alias("kind"), (F.col("n") > 0).alias("passed"), F.lit(description).cast("string").alias("description"))

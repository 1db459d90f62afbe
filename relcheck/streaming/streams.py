"""Streaming operators over logs (T1-T5): run_id, sequence, recorded_at, package_id, action, outcome, ...

Event times are cast to TIMESTAMP, which watermarks need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.commits import commit
from .processors import Attempts, Gaps, rocksdb_state


def timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("recorded_at", F.col("recorded_at").cast("timestamp")).withWatermark("recorded_at", watermark)


def stream_failures(events: DataFrame, window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Counts and mean duration by window, action, outcome and sqlstate; rows later than the watermark are dropped."""
    span = F.window("recorded_at", window, slide) if slide else F.window("recorded_at", window)
    grouped = timed(events, watermark).groupBy(span.alias("w"), "action", "outcome", "sqlstate").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "action", "outcome", "sqlstate", "n", "mean_ms")


def stream_attempts(events: DataFrame, timeout_ms: int, watermark: str) -> DataFrame:
    """(package_id, change, at): opened by an attempt, closed by a success or resolution, alert when still open after the timeout.

    Timers run on event time; an event that closes a package at its deadline or later gives `retracted` after the `alert`.
    Changes come once the watermark has passed them and don't depend on the order or the batches in which events
    come in: events go by time, run and sequence (null first). Events without a time are dropped. Needs rocksdb_state().
    """
    kept = events.where("recorded_at IS NOT NULL AND action IN ('deploy', 'resolve', 'baseline') AND outcome IN ('attempted', 'succeeded', 'asserted_applied', 'asserted_not_applied')")
    low = F.lit(-(1 << 63)).cast("long")
    small = timed(kept, watermark).select("package_id", F.coalesce(F.col("run_id").cast("long"), low).alias("run_id"), F.coalesce(F.col("sequence").cast("long"), low).alias("sequence"), (F.col("outcome") != "attempted").alias("closes"), F.unix_millis("recorded_at").alias("at"), "recorded_at")
    return small.groupBy("package_id").transformWithStateInPandas(Attempts(timeout_ms), "package_id long, change string, at long", "append", "eventTime")


def stream_dedup(events: DataFrame, watermark: str) -> DataFrame:
    """Drops replays of (run_id, sequence) that come within the watermark."""
    return timed(events, watermark).dropDuplicatesWithinWatermark(["run_id", "sequence"])


def stream_gaps(events: DataFrame, watermark: str, forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """(run_id, change, expected, found): a `gap` where a run's sequence jumps, `filled` where a late number changes or closes a gap.

    A gap is the first number that is missing and the next one that was seen; numbers count from 1. What stands
    in the end (see standing_gaps) doesn't depend on the order in which events come in within the watermark.
    A run without an event for `forget_ms` of event time is forgotten, so that state is held for recent runs only;
    if it goes on after that, its sequence counts from 1 again. Rows later than the watermark, or without a time or
    sequence, are dropped. Needs rocksdb_state().
    """
    small = timed(events.where("recorded_at IS NOT NULL AND sequence IS NOT NULL"), watermark).select("run_id", F.col("sequence").cast("long").alias("sequence"), F.unix_millis("recorded_at").alias("at"), "recorded_at")
    return small.groupBy("run_id").transformWithStateInPandas(Gaps(forget_ms), "run_id long, change string, expected long, found long", "append", "eventTime")


def standing_gaps(changes: DataFrame) -> DataFrame:
    """The gaps (run_id, expected, found) that have been reported and not been filled."""
    net = changes.groupBy("run_id", "expected", "found").agg(F.sum(F.when(F.col("change") == "gap", 1).otherwise(-1)).alias("n"))
    return net.where("n > 0").select("run_id", "expected", "found")


def stream_checks(events: DataFrame, rules: dict[str, Column], path: str, checkpoint: str, name: str = "checks") -> DataStreamWriter:
    """T4: runs the rules on every micro-batch and commits its result rows, as batch `<name>-<number>` of the table `checks`.

    Readers (see commits.committed) see whole batches only. A batch that is run again after a restart has been
    committed or is written anew, so results are the same; a stream with another checkpoint needs another name.
    """
    from ..operators.rows import check_all

    def write(batch: DataFrame, number: int) -> None:
        commit({"checks": check_all(batch, rules)}, path, f"{name}-{number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_run_sessions(events: DataFrame, gap: str, watermark: str, key: str = "package_id") -> DataFrame:
    """T5: runs by inactivity where events carry no run id: start, end and events of each session of a key."""
    grouped = timed(events, watermark).groupBy(F.session_window("recorded_at", gap).alias("s"), key).agg(F.count("*").alias("events"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return grouped.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "failed")


def replay(events: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], parts: int, checkpoint: str, order_by: str = "recorded_at", mode: str = "append") -> DataFrame:
    """Writes events as `parts` files by time, streams them one file a batch through `build` and returns what it has put out."""
    spark = events.sparkSession
    (events.repartitionByRange(parts, order_by).sortWithinPartitions(order_by).write.mode("overwrite").parquet(f"{path}/in"))
    # the file source takes the oldest file first: file times follow the events' order
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/in")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    for i, file in enumerate(files):
        fs.setTimes(file, 1_600_000_000_000 + 60_000 * i, -1)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    with rocksdb_state(spark):
        query = build(source).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", f"{path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")

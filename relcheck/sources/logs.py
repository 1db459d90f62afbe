"""Sources and sinks: history logs, reports and checksum files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .commits import commit, committed

#: The report versions that read_reports accepts.
VERSIONS = (1,)

_ERROR = "struct<code:string, message:string, hint:string, sqlstate:string>"
REPORT = (
    "struct<report_version:int, tool:struct<name:string, version:string>, run:struct<id:string, command:string, started_at:string, finished_at:string, duration_ms:bigint>, outcome:string, exit_code:int,"
    " target:struct<name:string, database:string, server_version:string>,"
    f" migrations:array<struct<id:string, slug:string, action:string, status:string, transaction:string, definition_sha256:string, scripts:array<struct<role:string, path:string, sha256:string, status:string, duration_ms:bigint, error:{_ERROR}>>, duration_ms:bigint, error:{_ERROR}>>,"
    f" tests:array<struct<path:string, sha256:string, status:string, planned:bigint, duration_ms:bigint, error:{_ERROR}, assertions:array<struct<number:bigint, description:string, status:string, directive_reason:string, diagnostics:map<string,string>>>>>,"
    f" diagnostics:array<struct<severity:string, code:string, message:string, migration_id:string, hint:string>>, error:{_ERROR}>"
)


def append_history(history: DataFrame, path: str, batch: str | None = None, evidence: DataFrame | None = None) -> bool:
    """Appends events to a log partitioned by day, and their evidence with them; one call is one commit.

    Readers see all of it or nothing. A batch that has been committed is not written again (False);
    without a name each call is a batch of its own.
    """
    dated = history.withColumn("date", F.to_date("recorded_at"))
    tables = {"history": dated.repartition("date", F.pmod(F.xxhash64("run_id"), F.lit(16)))}
    if evidence is not None:
        tables["evidence"] = evidence
    return commit(tables, path, batch or uuid.uuid4().hex, {"history": ["date"]})


def history_sink(events: DataFrame, path: str, checkpoint: str, name: str) -> DataStreamWriter:
    """S4 for a stream: each micro-batch is one commit, `<name>-<number>`, written once also after a restart.

    A stream that starts anew, with another checkpoint, needs another name.
    """
    return events.writeStream.foreachBatch(lambda rows, number: append_history(rows, path, f"{name}-{number}")).option("checkpointLocation", checkpoint)


def read_history(spark: SparkSession, path: str, table: str = "history") -> DataFrame:
    """The committed log, or the evidence; filters on `date` prune folders."""
    return committed(spark, path, table).drop("batch")


def parse_reports(documents: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of JSON report documents.

    Accepted rows have the parsed `report`; unknown fields and values are tolerated. Rejected rows have the text
    and a reason: malformed, or the version that is not known.
    """
    parsed = documents.withColumn("report", F.from_json(column, REPORT))
    version = F.col("report.report_version")
    known = F.coalesce(version.isin(*VERSIONS), F.lit(False))
    accepted = parsed.where(known).select("report")
    reason = F.when(version.isNull(), F.lit("malformed")).otherwise(F.concat(F.lit("unknown version "), version.cast("string")))
    return accepted, parsed.where(~known).select(F.col(column).alias("document"), reason.alias("reason"))


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S5 over a folder with one document a line."""
    return parse_reports(spark.read.text(path))


def parse_checksum_lines(lines: DataFrame, column: str = "value", line: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(sums, problems) of `<64 hex digits>  <path>` lines; blank lines are skipped.

    problems: line, problem (malformed or listed_twice) and the text; a path listed twice keeps no sum. `line`
    numbers the lines; without it they are numbered by a `line` column.
    """
    numbered = lines.select((line if line is not None else F.col("line")).alias("line"), F.col(column).alias("text")).where(F.trim("text") != "")
    pattern = r"^([0-9a-fA-F]{64})  (.+)$"
    ok = F.col("text").rlike(pattern)
    good = numbered.where(ok).select("line", "text", F.regexp_extract("text", pattern, 2).alias("path"), F.lower(F.regexp_extract("text", pattern, 1)).alias("sha256"))
    listed = good.groupBy("path").agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"))
    sums = listed.where("n = 1").select("path", "sha256")
    twice = good.join(listed.where("n > 1").select("path"), "path", "left_semi").select("line", F.lit("listed_twice").alias("problem"), "text")
    bad = numbered.where(~ok).select("line", F.lit("malformed").alias("problem"), "text")
    return sums, bad.unionByName(twice)

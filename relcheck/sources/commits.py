"""Appends that are seen whole or not at all, and once, however often a writer is started again.

Below a path, `data/<table>/batch=<batch>.<attempt>` has the files of one attempt to write one batch and
`commits/<batch>` is its commit record, which names the attempt. The record is made last, by an atomic rename
that fails if the batch has one. Readers take the attempts that records name, so files of an
attempt that broke off, or lost, are never seen; several tables of one commit appear together.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def _jvm(spark: SparkSession):
    return spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()


def _path(spark: SparkSession, path: str):
    return _jvm(spark)[0].org.apache.hadoop.fs.Path(path)


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    record = _path(spark, f"{path}/commits/{batch}")
    return record.getFileSystem(_jvm(spark)[1]).exists(record)


def commit(tables: dict[str, DataFrame], path: str, batch: str, partition_by: dict[str, list[str]] | None = None) -> bool:
    """Writes the tables as one batch; False, and nothing new to read, if the batch has been committed.

    batch: letters, digits, `.`, `_` and `-`; a writer that may be started again gives the same name to the same rows.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"a batch name has letters, digits, '.', '_' and '-' only: {batch!r}")
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, path, batch):
        return False
    attempt = f"{batch}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path}/data/{name}/batch={attempt}")
    jvm, conf = _jvm(spark)
    draft, record = _path(spark, f"{path}/drafts/{attempt}"), _path(spark, f"{path}/commits/{batch}")
    files = draft.getFileSystem(conf)
    out = files.create(draft, False)
    out.writeBytes(attempt + "\n")
    out.close()
    files.mkdirs(record.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(record), none)
    except Exception:
        if is_committed(spark, path, batch):  # by another writer meanwhile
            return False
        raise
    return True


def committed(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All rows of a table in committed batches, with the column `batch`, which filters prune folders by.

    Records are read by Spark; their names, one a batch, come to the driver, as the folders that it lists do.
    """
    records = _path(spark, f"{path}/commits")
    if not records.getFileSystem(_jvm(spark)[1]).exists(records):
        raise ValueError(f"nothing has been committed to {path}")
    attempts = sorted(r[0] for r in spark.read.text(f"{path}/commits").collect())
    base = f"{path}/data/{table}"
    folders = [f"{base}/batch={a}" for a in attempts]
    files = _path(spark, base).getFileSystem(_jvm(spark)[1])
    there = [f for f in folders if files.exists(_path(spark, f))]
    if not there:
        raise ValueError(f"no committed batch of {path} has a table {table}")
    df = spark.read.option("basePath", base).option("mergeSchema", "false").parquet(*there)
    # the attempt's own name, of 33 characters, is no part of the batch
    named = F.col("batch").cast("string")
    return df.withColumn("batch", F.substring(named, F.lit(1), F.length(named) - 33))

"""Vectorised scans over Arrow string batches, shared by the text operators.

Texts of a batch lie in one UTF-8 buffer; words, word hashes and window hashes are found with
numpy over that whole buffer, so a task never loops over characters in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Bytes of text handled at once in a task; single texts beyond it are handled whole, alone.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to a task's Python at once, so that a worker holds a few MB of usual texts.
BATCH_ROWS = 1000
#: Bytes of a word up to which power sums serve as its hash.
LONG_WORD = 256

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table that is true for the bytes of the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = 1 << (n - 1).bit_length()
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def map_batches(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS at most: the session's own limit counts if it is lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece has about `limit` bytes of text at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets of each (rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of maximal runs of wanted bytes, and where each text's words begin (rows + 1)."""
    n = len(data)
    inside = wanted[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each pair, equal for equal content wherever it lies."""
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power("up", len(codes)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power("down", len(codes) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes data[start:end] of each pair.

    Spans beyond LONG_WORD bytes are hashed by BLAKE2b: power sums can't tell some long texts of two letters apart.
    """
    out = span_hashes(_BYTE_CODE[data], starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the count of each row."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


def cut_spans(data: np.ndarray, off: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    """Each text without the byte ranges [first, last); ranges lie within texts and may overlap."""
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, last, -1)
    keep = np.cumsum(change[:-1]) <= 0
    kept = data[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    return [kept[a:b].decode("utf-8", "replace") for a, b in zip(at.tolist(), at[1:].tolist())]


def set_apart(df: DataFrame, *known: str) -> tuple[DataFrame, dict[str, str]]:
    """df with every column but the known ones under a name that no operator uses, and those names by the old ones."""
    names = {c: f"other column {i}" for i, c in enumerate(df.columns) if c not in known}
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns)), names


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir; one of its own only where that is unset."""
    have = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        have = spark.sparkContext.getCheckpointDir()
    if not have:
        import tempfile

        spark.sparkContext.setCheckpointDir(have := tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return have


def fits(df: DataFrame, most_rows: int) -> DataFrame:
    """df, to be broadcast if it has `most_rows` rows at most; beyond that a join with it shuffles both sides."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


#: Narrow rows that one task writes where their number is bounded: small tables in hundreds of files cost more than their rows.
FILE_ROWS = 10_000
#: Folders staged within the scratch() at hand; none outside of one.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _folder(spark: SparkSession, path: str):
    """The path and its file system, which need not be a local one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there, lost executors cost no rework.

    The folder goes at the end of the scratch() around it, else when the driver's JVM ends. Where a bound of the
    rows is known, df is written in no more files than FILE_ROWS rows each need.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(1 + most_rows // FILE_ROWS)
    path = f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, files = _folder(spark, path)
    files.deleteOnExit(target)
    if (mine := _scratch.get()) is not None:
        mine.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a staged table that nothing reads any more."""
    target, files = _folder(df.sparkSession, df.staged_path)
    files.delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is staged inside at the end; gives a function that stages what is to outlive it."""
    outer, mine = _scratch.get(), []
    token = _scratch.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        out = staged(df)
        mine.remove(out.staged_path)
        if outer is not None:
            outer.append(out.staged_path)
        return out

    try:
        yield keep
    finally:
        _scratch.reset(token)
        for path in mine:
            target, files = _folder(spark, path)
            files.delete(target, True)

"""Shared helpers: reading tables, cutting lineage in the shared folder, and vectorised word hashing in tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step takes at a time; only a single longer text makes a larger step.
STEP_BYTES = 1 << 18
#: Bytes of an Arrow batch that a worker is handed.
BATCH_BYTES = 4 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by any path that Spark's readers open."""
    _bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few megabytes, so that a worker never holds many rows of long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def saved(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    _bounded_batches(spark)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are needed only until a result is saved."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def clear(self, spark: SparkSession) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths = []


def wider(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df with further columns."""
    extra = StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in kinds.items()))
    return StructType([*df.schema.fields, *extra.fields])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without copying; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about STEP_BYTES of text each: (slice, bytes, offsets)."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            filled = np.full(size, base, np.uint64)
            filled[0] = 1
            tables.append(np.multiply.accumulate(filled))
        if size > 8 * STEP_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all texts, and each text's first word (one more entry than texts)."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(_SEPARATOR[data], out=inside[:-1])
    inside[-1] = False
    begins, ends = inside[:-1].copy(), inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    ends &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased; their starts and ends; each text's first word.

    A word's hash is a polynomial over random byte values modulo 2^64, taken from running sums, then mixed with its
    length; it depends on the word's bytes only.
    """
    starts, ends, first = word_bounds(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, first
    power, inverse = _power_tables(len(data) + 1)
    running = np.empty(len(data) + 1, np.uint64)
    running[0] = 0
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=running[1:])
    h = (running[ends] - running[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends, first


_STEP = [np.uint64(x) for x in np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, one text after the other, and where each text's begin (one more entry).

    With fewer than k words the whole sequence is one shingle; a text without words has none."""
    counts = np.diff(first)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k if n >= k else 0):
        rolled += _STEP[j] * words[j : n - k + 1 + j]
    rolled = mix(rolled)
    of = np.repeat(np.arange(len(counts)), np.maximum(counts - k + 1, 0))
    starts = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0))))[:-1], np.maximum(counts - k + 1, 0))
    values = rolled[np.arange(len(of)) + starts]
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        short = counts[few].astype(np.uint64)
        for j in range(k - 1):
            there = counts[few] > j
            short[there] = mix(short[there] + words[first[few][there] + j] * _STEP[j])
        values, of = np.concatenate([values, short]), np.concatenate([of, few])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[fresh], np.searchsorted(of[fresh], np.arange(len(counts) + 1))

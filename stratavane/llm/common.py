"""Shared folders, ordered blocks and byte-level helpers for the operators."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import drop_path, fresh_path

REPO_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of a batch, of Parquet's reader and of Arrow: texts are long, and readers and workers hold a few copies of a batch.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": (512, "4096"), "spark.sql.execution.arrow.maxRecordsPerBatch": (2000, "10000")}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver found it, and keep batches of whole texts small. Plans read
    these settings when they run, so they stay for the session; smaller ones of the caller's are left alone."""
    for name, (rows, usual) in BATCH_ROWS.items():
        if int(spark.conf.get(name, usual)) > rows:
            spark.conf.set(name, str(rows))
    env = spark.sparkContext.environment
    have = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if REPO_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *have])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame | None) -> None:
    """Deletes what ``materialise`` wrote, once nothing reads it any more."""
    for df in stored:
        if df is not None and getattr(df, "_stored_at", None):
            drop_path(df.sparkSession, df._stored_at)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now: its cleaner waits for the JVM's collector, and the last
    query's are held until another one has run."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        spark.range(1).collect()
        jvm.System.gc()


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; np.unique hashes large arrays, which is many times slower than sorting them."""
    if not len(values):
        return values
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def in_order(docs: DataFrame, block_bytes: int) -> DataFrame:
    """doc_id and text in partitions of ascending doc_id, null first, of about ``block_bytes`` of text each; rows of one
    doc_id are ordered by text, and go to several partitions where the first 64 characters differ. The number of partitions
    grows with the input."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("start", F.substring("text", 1, 64))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "start", "text")]
    laid = docs.repartitionByRange(max(1, -(-size // block_bytes)), *order[:2])
    return laid.sortWithinPartitions(*order).select("doc_id", "text")


def utf8_column(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary array and its n+1 offsets; null is empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e] for each range; equal bytes have equal hashes."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_ranges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words (runs of bytes other than space and 0x09 to 0x0D) of all texts."""
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~_SPACE[data]
    begin = word[1:-1] & ~word[:-2]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = word[1:-1][inner]
    stop = word[1:-1] & ~word[2:]
    stop[inner - 1] = word[1:-1][inner - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def batches_of_text(col, most: int = 1 << 20):
    """Slices (first row, last row, bytes, offsets) of an Arrow column with about ``most`` bytes or a single text each."""
    data, off = utf8_column(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def gathered(batches, rows: int = 1 << 17):
    """NumPy columns of several Arrow batches of numbers at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns])
        n += batch.num_rows
        if n >= rows:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def unused(names: list[str], base: str) -> str:
    """A column name like ``base`` that isn't among ``names``."""
    while base.lower() in {n.lower() for n in names}:
        base = f"_{base}"
    return base

"""Shared helpers: the scratch folder, Arrow text buffers and vectorised hashing."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_dir()


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="geofeat-")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now: it learns of them when the driver collects its garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def settled(df: DataFrame, name: str, mark: int) -> DataFrame:
    """``df`` as a written table; the scratch tables made since ``mark`` (from ``scratch_mark``), which only it needed, are deleted."""
    inner = _WRITTEN[mark:]
    out = materialize(df, name)
    del _WRITTEN[mark : mark + len(inner)]
    _delete(df.sparkSession, inner)
    return out


def scratch_mark() -> int:
    return len(_WRITTEN)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote; call it when no result that reads it is in use any more."""
    paths = _WRITTEN[:]
    _WRITTEN.clear()
    _delete(spark, paths)


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: extra columns, clashing names among them, never reach an operator."""
    return df.select(*[df[c] for c in columns])


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """The rows with ``part`` (a range of the order), ``pos`` (place within the group, from 0) and ``n`` (rows of the group).

    Rows are cut into ranges of (group, order), so that a group of any size is many tasks; a row's place is its place within the range plus the
    rows of its group in the ranges before. Equal rows are parted by where they were read, so that any number of them is spread, too.
    """
    by = [F.col(g).asc_nulls_first() for g in group] + order + [F.col("tie")]
    cut = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    cut = materialize(cut.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    runs = cut.groupBy(*group, "part").agg(F.min("at").alias("lo"), F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*group, "part", (before - F.col("lo")).alias("shift"), F.sum("m").over(Window.partitionBy(*group)).alias("n"))
    return cut.join(runs, [*group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "shift")


def give_back() -> None:
    """A task's memory back to the system: a Python worker outlives its task, and others want it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freed(run):
    """``run`` (over Arrow batches), and at the task's end its memory is given back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


# ---------------------------------------------------------------- Arrow text

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A-Z to lower case, the white space 0x09-0x0D to a blank.
FOLD_SPACE = _LOWER.copy()
FOLD_SPACE[9:14] = 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch by rows so that each piece holds about ``limit`` bytes of text (one longer text stays whole)."""
    off, _ = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = min(end, n)


def words(off: np.ndarray, folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words (runs of bytes other than a blank), and for each text the index of its first word."""
    is_word = folded != 32
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    cut = off[1:-1]
    cut = cut[cut < len(folded)]
    begins[cut] = is_word[cut]
    starts = np.flatnonzero(begins)
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    inner = cut[cut > 0] - 1
    ends[inner] = is_word[inner]
    lengths = np.flatnonzero(ends) + 1 - starts
    return starts, lengths, np.searchsorted(starts, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit multilinear hash of each word: one odd multiplier a byte value and one a place."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = mix64((np.arange(int(lengths.max()), dtype=np.uint64) + np.uint64(0x51)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = np.cumsum(lengths)
    within = np.arange(total[-1]) - np.repeat(total - lengths, lengths)
    text = folded[folded != 32]
    sums = np.add.reduceat(_BYTE[text] * place[within], total - lengths)
    return mix64(sums + lengths.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as signed ones in the same order."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)

"""Shared pieces of the operators: shared-folder tables, table reading, Arrow batch slicing."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step handles at once (a longer single text is its own step).
SLICE_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and Spark is local."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="seqcorpus-llm-"))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage is cut, every later
    use sees the same rows, and a lost executor costs only its own running tasks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a written table that a later written table has replaced."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffle_parts(spark: SparkSession, least: int):
    """At least so many shuffle partitions for the jobs that run inside."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(least, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: int = 1000, least: int = 1000) -> DataFrame:
    """``left`` (a written table, read more than once) with the columns of ``right`` (narrow, one row a key), as a
    left join.  Keys with more than a ``hot``-th of the rows, and more than ``least``, are fewer than ``hot``: their
    rows of ``right`` are broadcast.  All other keys meet in a shuffle, where none is large.  ``key`` isn't null."""
    limit = max(least, left.count() // hot)
    frequent = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key)
    frequent = written(frequent, "hot-keys")
    few = F.broadcast(frequent)  # fewer than ``hot`` rows
    of_hot = written(right.join(few, key, "left_semi"), "hot-rows")
    return left.join(few, key, "left_semi").join(F.broadcast(of_hot), key, "left").unionByName(
        left.join(few, key, "left_anti").join(right, key, "left"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan of fewer splits than cores (one small file) over the cores by ``key``."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.inputFiles() and len(df.inputFiles()) == 1 and \
        df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and its row offsets (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string()).fill_null("")
    else:
        arr = arr.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(off: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def binary_blobs(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def long_list(values: np.ndarray, counts: np.ndarray, kind=np.int32) -> pa.ListArray:
    """A list column from flat values and the number of values of each row."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.astype(kind)))


def wordless(col) -> object:
    """True where the text has no word character (null and white space alone included)."""
    return F.coalesce(F.regexp_replace(col, r"[\x20\x09-\x0D]+", ""), F.lit("")) == ""


def local_dir() -> str:
    """A task's own scratch folder (deleted by the task): only for spill files inside one task."""
    return tempfile.mkdtemp(prefix="spill-", dir=os.environ.get("TMPDIR"))

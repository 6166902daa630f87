"""Binary indexed datasets as a Spark data source: SRC-08 ``read_indexed``, SRC-09 ``write_indexed``.

A dataset is a pair of files, or a folder of such pairs (shards) whose items are numbered on in the order of their names:

``.idx``  magic ``TNTIDX\\0\\0``; then little-endian 64-bit numbers: version 1, code of the element type, element size, n items,
          s sizes; dim_offsets[n + 1], data_offsets[n + 1] (in elements), sizes[s].  Item i has the dimensions
          sizes[dim_offsets[i]:dim_offsets[i + 1]].
``.bin``  the elements of all items, one after the other; ids are stored plus one.

Reading: the driver reads the 48-byte headers only and cuts the items into ranges; a task seeks its own part of the index and one
byte range of the data.  Comparisons of ``item`` with constants prune ranges before any task starts; ``read_indexed`` turns
``spark.sql.python.filterPushdown.enabled`` on for that.  Writing: a partition writes one shard under a temporary name; the commit
gives the shards their names in partition order, an abort deletes them, so a failed task leaves none.  The path must be on a
file system that the driver and all executors have mounted.
"""

from __future__ import annotations

import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

# --- fixed values: the file format ----------------------------------------------------------
MAGIC = b"TNTIDX\x00\x00"
VERSION = 1
HEADER = 48
ELEMENT_TYPES = {1: "u1", 2: "i1", 3: "<i2", 4: "<i4", 5: "<i8", 6: "<f4", 7: "<f8"}

BATCH_ELEMENTS = 1 << 20


@dataclass
class ItemRange(InputPartition):
    prefix: str
    first: int  # number of the shard's first item in the dataset
    low: int  # items of the shard
    high: int

    def __init__(self, prefix, first, low, high):
        self.prefix, self.first, self.low, self.high = prefix, first, low, high


@dataclass
class Shard(WriterCommitMessage):
    partition: int
    prefix: str | None


def _prefixes(path: str) -> list[str]:
    """The dataset's shards in order."""
    if os.path.exists(path + ".idx"):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(f"no indexed dataset at {path}")
    return sorted(os.path.join(path, f[:-4]) for f in os.listdir(path) if f.endswith(".idx") and not f.startswith("_"))


def read_header(prefix: str) -> tuple[int, int, int, int]:
    """(code, element size, items, sizes) of a shard."""
    with open(prefix + ".idx", "rb") as f:
        raw = f.read(HEADER)
    if len(raw) < HEADER or raw[:8] != MAGIC or struct.unpack("<Q", raw[8:16])[0] != VERSION:
        raise ValueError(f"{prefix}.idx is no index of version {VERSION}")
    code, size, n, s = struct.unpack("<4Q", raw[16:])
    if code not in ELEMENT_TYPES or np.dtype(ELEMENT_TYPES[code]).itemsize != size:
        raise ValueError(f"{prefix}.idx: element type {code} of {size} bytes")
    return code, size, n, s


def _longs(f, at: int, n: int) -> np.ndarray:
    f.seek(at)
    return np.frombuffer(f.read(8 * n), "<i8")


class IndexedReader(DataSourceReader):
    def __init__(self, path: str, per: int, shift: int):
        self.path, self.per, self.shift = path, per, shift
        self.low, self.high = 0, None  # item numbers asked for

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("item",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
            yield f  # Spark checks every filter again

    def partitions(self):
        out, first = [], 0
        for prefix in _prefixes(self.path):
            n = read_header(prefix)[2]
            low = max(0, self.low - first)
            high = n if self.high is None else min(n, self.high + 1 - first)
            out += [ItemRange(prefix, first, a, min(a + self.per, high)) for a in range(low, high, self.per)]
            first += n
        return out

    def read(self, part: ItemRange | None):
        if part is None:  # no range is left
            return
        code, size, n, _ = read_header(part.prefix)
        count = part.high - part.low
        with open(part.prefix + ".idx", "rb") as f:
            dims = _longs(f, HEADER + 8 * part.low, count + 1)
            at = _longs(f, HEADER + 8 * (n + 1 + part.low), count + 1)
            sizes = _longs(f, HEADER + 16 * (n + 1) + 8 * int(dims[0]), int(dims[-1] - dims[0]))
        with open(part.prefix + ".bin", "rb") as f:
            lo = 0
            while lo < count:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BATCH_ELEMENTS, "right")) - 1)
                hi = min(hi, count)
                f.seek(int(at[lo]) * size)
                flat = np.frombuffer(f.read(int(at[hi] - at[lo]) * size), ELEMENT_TYPES[code])
                if len(flat) != at[hi] - at[lo]:
                    raise ValueError(f"{part.prefix}.bin ends before item {lo + part.low}")
                ids = flat.astype(np.int64) - self.shift
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(lo, hi) + part.low + part.first), _lists(sizes, dims[lo:hi + 1] - dims[0]), _lists(ids, at[lo:hi + 1] - at[lo], cut=False)],
                    names=["item", "dims", "ids"])
                lo = hi


def _lists(values: np.ndarray, offsets: np.ndarray, cut: bool = True) -> pa.Array:
    flat = values[offsets[0]:offsets[-1]] if cut else values
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(flat))


class IndexedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, code: int, shift: int, names: list[str]):
        self.path, self.code, self.shift, self.column = path, code, shift, names.index("ids")

    def write(self, batches):
        kind = np.dtype(ELEMENT_TYPES[self.code])
        prefix = os.path.join(self.path, f"_{uuid.uuid4().hex}")
        sizes, done = [], False
        os.makedirs(self.path, exist_ok=True)
        try:
            with open(prefix + ".bin", "wb") as f:
                for batch in batches:
                    col = batch.column(self.column)
                    sizes.append(np.diff(np.asarray(col.offsets, np.int64)) if not col.null_count else np.array([len(x or ()) for x in col.to_pylist()], np.int64))
                    flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False)) + self.shift
                    if len(flat) and (flat.min() < np.iinfo(kind).min or flat.max() > np.iinfo(kind).max):
                        raise ValueError(f"ids from {flat.min()} to {flat.max()} (with the shift) don't fit {kind}")
                    f.write(flat.astype(kind).tobytes())
            sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            with open(prefix + ".idx", "wb") as f:
                f.write(MAGIC + struct.pack("<5Q", VERSION, self.code, kind.itemsize, len(sizes), len(sizes)))
                for longs in (np.arange(len(sizes) + 1), np.concatenate([[0], np.cumsum(sizes)]), sizes):
                    f.write(longs.astype("<i8").tobytes())
            done = True
        finally:
            if not done or not len(sizes):
                _remove(prefix)
        return Shard(TaskContext.get().partitionId(), prefix if len(sizes) else None)

    def commit(self, messages):
        shards = sorted((m for m in messages if m is not None and m.prefix), key=lambda m: m.partition)
        if not shards:  # an empty dataset is a shard without items
            os.makedirs(self.path, exist_ok=True)
            empty = os.path.join(self.path, f"_{uuid.uuid4().hex}")
            open(empty + ".bin", "wb").close()
            with open(empty + ".idx", "wb") as f:
                f.write(MAGIC + struct.pack("<5Q", VERSION, self.code, np.dtype(ELEMENT_TYPES[self.code]).itemsize, 0, 0) + bytes(16))
            shards = [Shard(0, empty)]
        for k, shard in enumerate(shards):
            for end in (".bin", ".idx"):  # the index last: a reader sees whole shards only
                os.replace(shard.prefix + end, os.path.join(self.path, f"part-{k:05d}{end}"))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.prefix:
                _remove(m.prefix)


def _remove(prefix: str) -> None:
    for end in (".bin", ".idx"):
        if os.path.exists(prefix + end):
            os.unlink(prefix + end)


class IndexedDataset(DataSource):
    """Format ``indexed``.  Options: ``path``; ``items`` a read partition; ``shift`` between ids and stored values; ``code`` of the
    element type written.  Rows: (item, dims, ids); written rows need the column ``ids``."""

    @classmethod
    def name(cls):
        return "indexed"

    def schema(self):
        return "item long, dims array<long>, ids array<long>"

    def _path(self):
        return self.options["path"].removeprefix("file://").removeprefix("file:")

    def reader(self, schema):
        return IndexedReader(self._path(), int(self.options.get("items", 100_000)), int(self.options.get("shift", 1)))

    def writer(self, schema, overwrite):
        path = self._path()
        if os.path.isdir(path) and any(f.endswith(".idx") for f in os.listdir(path)):
            raise FileExistsError(f"{path} holds an indexed dataset")
        return IndexedWriter(path, int(self.options.get("code", 4)), int(self.options.get("shift", 1)), schema.names)


def read_indexed(spark: SparkSession, path: str, items: int = 100_000, shift: int = 1) -> DataFrame:
    """SRC-08: ``(item, dims, ids)`` of the dataset with that prefix, or of the folder's shards."""
    spark.dataSource.register(IndexedDataset)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("indexed").option("items", items).option("shift", shift).load(path)


def write_indexed(df: DataFrame, path: str, order_cols: list[str], ids: str = "ids", code: int = 4, shift: int = 1,
                  shards: int | None = None) -> None:
    """SRC-09: a new folder of shards whose items are the rows of ``df`` in the order of ``order_cols`` (null ids: an empty item);
    as many as Spark sorts into, or at most ``shards``."""
    df.sparkSession.dataSource.register(IndexedDataset)
    ordered = df.repartitionByRange(shards, *order_cols).sortWithinPartitions(*order_cols) if shards else df.orderBy(*order_cols)
    rows = ordered.select(df[ids].cast("array<long>").alias("ids"))
    rows.write.format("indexed").option("code", code).option("shift", shift).mode("append").save(path)

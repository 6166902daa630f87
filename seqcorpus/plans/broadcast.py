"""Broadcast only behind a checked size bound in rows and bytes, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcorpus.plans.session import scratch_path

# default bounds for broadcasting a lookup table (vocabularies, lexicons, plan tables)
DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 128 << 20
_WIDTH = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4}


def _bytes(name: str, kind: T.DataType) -> Column:
    """About how many bytes a column's value takes in memory."""
    col = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.greatest(F.size(col), F.lit(0)), F.lit(0)) * _WIDTH.get(type(kind.elementType), 8) + 24
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.length(F.to_json(F.struct(col))), F.lit(0)) + 24
    return F.lit(_WIDTH.get(type(kind), 8))


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared scratch folder, so that counting and joining it don't run its plan twice."""
    path = scratch_path(df.sparkSession, "lookup")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes in memory, about), by one distributed aggregation."""
    total = sum((_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("b")).first()
    return row.n, row.b or 0


def row_count_at_most(df: DataFrame, limit: int) -> int | None:
    """Exact row count when it is <= limit, else None."""
    n = df.count()
    return n if n <= limit else None


def maybe_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its rows and bytes are proven to be within the bounds; otherwise ``df`` as it is, so
    the planner picks a shuffle (sort-merge) join and AQE can split skewed partitions.  Its plan runs once, either way."""
    held = stored(df)
    rows, size = size_of(held)
    return F.broadcast(held) if rows <= max_rows and size <= max_bytes else held

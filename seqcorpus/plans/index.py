"""Distributed row numbering and running sums over a total order.

``global_index`` is the DataFrame form of ``zipWithIndex``: rows are range-partitioned and sorted
on the order columns, every row gets (partition, local position) from
``monotonically_increasing_id``, the frame is checkpointed so both uses see the same rows, the
per-partition counts (one row per partition) are turned into offsets, and the offsets are
broadcast back.  No step moves all rows through one task, whatever the key skew: range
partitioning splits even a single hot key value when the order columns include a unique tie key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqcorpus.plans.session import cut_lineage, shuffle_partitions

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def _ordered_tagged(df: DataFrame, order_cols, num_partitions: int | None) -> DataFrame:
    n = num_partitions or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    return cut_lineage(tagged)


def _partition_offsets(tagged: DataFrame, weight=None) -> DataFrame:
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    per_part = tagged.groupBy(part.alias("_p")).agg(F.sum(w).alias("_n"))
    # one row per partition: an un-partitioned window over this tiny frame is fine
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))


def global_index(df: DataFrame, order_cols, name: str = "idx", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of the row in the total order ``order_cols``.

    ``order_cols`` must make the order total (end with a unique key) for a deterministic result.
    """
    tagged = _ordered_tagged(df, order_cols, num_partitions)
    offsets = _partition_offsets(tagged)
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))
    return (
        tagged.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, (F.col("_off") + local).cast("long"))
        .drop("_p", "_off", "_mid")
    )


def global_cumsum(df: DataFrame, order_cols, value_col: str, name: str = "cum",
                  inclusive: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = running sum of ``value_col`` over the total order (exclusive by default,
    i.e. the start offset of each row).  Same partition/offset scheme as ``global_index``."""
    tagged = _ordered_tagged(df, order_cols, num_partitions)
    offsets = _partition_offsets(tagged, F.col(value_col))
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    # running sum inside a range partition: the window key is the partition number, so every
    # window holds exactly one partition's rows (already co-located, bounded by the range split)
    w = Window.partitionBy("_p").orderBy("_mid")
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        tagged.withColumn("_p", part)
        .withColumn("_loc", F.coalesce(F.sum(F.col(value_col).cast("long")).over(frame), F.lit(0)))
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, (F.col("_off") + F.col("_loc")).cast("long"))
        .drop("_p", "_off", "_mid", "_loc")
    )


def global_positions(df: DataFrame, order_cols, value_col: str, index: str = "idx", cum: str = "cum",
                     num_partitions: int | None = None) -> DataFrame:
    """``global_index`` and the exclusive ``global_cumsum`` of ``value_col`` over one range partitioning."""
    tagged = _ordered_tagged(df, order_cols, num_partitions)
    part = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    value = F.col(value_col).cast("long")
    per_part = tagged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_v"))
    # one row per partition: an un-partitioned window over this tiny frame is fine
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"_o{c}") for c in ("_n", "_v")])
    frame = Window.partitionBy("_p").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    local = F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))
    return (tagged.withColumn("_p", part).withColumn("_loc", F.coalesce(F.sum(value).over(frame), F.lit(0)))
            .join(F.broadcast(offsets), "_p")
            .withColumn(index, (F.col("_o_n") + local).cast("long")).withColumn(cum, (F.col("_o_v") + F.col("_loc")).cast("long"))
            .drop("_p", "_o_n", "_o_v", "_mid", "_loc"))

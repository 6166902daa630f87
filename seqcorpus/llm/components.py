"""Connected components of an edge table, by alternating stars (large-star, small-star) over written tables.

A round is two aggregations and two joins on nodes; edges stay at most as many as at first, and a hub's
edges are never gathered: its smallest neighbour is aggregated map-side, and the join back can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcorpus.llm.common import written


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    on = e.join(least, "a")
    out = on.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another node; root is the component's smallest node."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    e = written(e, "edges")
    seen = None
    while seen != (now := _state(e)):
        seen = now
        e = written(_small(_large(e)), "edges")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return written(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots), "components")

"""Checkpoint and embedding tables: AGG-25, AGG-26, WIN-13, WIN-14, JN-06, JN-07.

A checkpoint set is ``(run, checkpoint, param STRING, vector ARRAY<DOUBLE>, is_int BOOLEAN)``.
Averaging explodes vectors to (param, pos) cells and aggregates them; the regroup per parameter
collects one value per element of that parameter only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcorpus.plans.broadcast import maybe_broadcast


def check_same_keys(ckpts: DataFrame, group_cols: list[str] | None = None, order_col: str = "param_no") -> DataFrame:
    """AGG-26: per group, whether every checkpoint has the same parameter names in the same order."""
    g = group_cols or []
    keys = ckpts.groupBy(*g, "checkpoint").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order_col, "param"))), lambda x: x["param"]).alias("_k"))
    return keys.groupBy(*g).agg((F.count_distinct(F.xxhash64("_k")) == 1).alias("same_keys"),
                                F.count(F.lit(1)).alias("n_checkpoints"))


def average_checkpoints(ckpts: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """AGG-25: element-wise mean per parameter over checkpoints; integer parameters truncate
    toward zero (7 and 2 → 4).  Raises when the key lists differ."""
    g = group_cols or []
    chk = check_same_keys(ckpts, g)
    if chk.filter(~F.col("same_keys")).limit(1).count() > 0:
        raise ValueError("checkpoints do not share the same parameter list")
    cells = ckpts.select(*g, "checkpoint", "param", "is_int", F.posexplode("vector").alias("pos", "v"))
    mean = cells.groupBy(*g, "param", "pos").agg(F.avg("v").alias("m"), F.max("is_int").alias("is_int"))
    mean = mean.withColumn("m", F.when(F.col("is_int"), F.col("m").cast("long").cast("double")).otherwise(F.col("m")))
    return mean.groupBy(*g, "param").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("vector"),
        F.max("is_int").alias("is_int"))


def _with_epoch(files: DataFrame, name_col: str, pattern: str) -> DataFrame:
    """Files whose whole name fits the pattern, with their number; others (checkpoint_best.pt) are skipped."""
    fits = files.filter(F.col(name_col).rlike(f"^(?:{pattern})$"))
    return fits.withColumn("epoch", F.regexp_extract(name_col, pattern, 1).try_cast("long")).filter(F.col("epoch").isNotNull())


def last_n_checkpoints(files: DataFrame, n: int, upper: int | None = None, name_col: str = "name",
                       pattern: str = r"checkpoint(\d+)\.pt") -> DataFrame:
    """WIN-13: epoch number parsed from the file name, <= upper, the n largest; fewer → error."""
    f = _with_epoch(files, name_col, pattern)
    if upper is not None:
        f = f.filter(F.col("epoch") <= upper)
    top = f.orderBy(F.col("epoch").desc()).limit(n)
    if top.count() < n:
        raise ValueError(f"fewer than {n} checkpoints found")
    return top


def prune_old_checkpoints(files: DataFrame, keep: int, name_col: str = "name",
                          pattern: str = r"checkpoint(\d+)\.pt") -> DataFrame:
    """WIN-14: all but the newest ``keep`` (lists the rows, deletes nothing)."""
    f = _with_epoch(files, name_col, pattern)
    newest = f.orderBy(F.col("epoch").desc()).limit(keep).select(name_col)
    return f.join(newest, name_col, "left_anti")


def attach_embeddings(vocab: DataFrame, emb: DataFrame, dim: int, default: float = 0.0) -> DataFrame:
    """JN-06: every vocabulary word gets its pretrained vector, others keep the default vector."""
    j = vocab.join(maybe_broadcast(emb.select("symbol", "vector")), "symbol", "left")
    return j.withColumns({"pretrained": F.col("vector").isNotNull(),
                          "vector": F.coalesce("vector", F.array_repeat(F.lit(default), dim))})


def embedding_overlap(vocab: DataFrame, emb: DataFrame) -> DataFrame:
    """JN-07: |embedding words ∩ vocabulary| / |vocabulary|."""
    known = emb.select("symbol").distinct().withColumn("_hit", F.lit(1))
    both = vocab.select("symbol").join(known, "symbol", "left").agg(F.count("_hit").alias("n_found"), F.count(F.lit(1)).alias("n_vocab"))
    overlap = F.when(F.col("n_vocab") > 0, F.col("n_found") / F.col("n_vocab")).otherwise(0.0)
    return both.select("n_found", "n_vocab", overlap.alias("overlap"))

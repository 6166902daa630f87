"""Bindings of the operators to the driver's parquet tables.

* corpus lines: ``documents`` broken into lines -> ``(doc_id, lang, source, line_no, text)``;
  the global line order is ``(doc_id, line_no)``.
* parallel pairs: ``conversations`` turn t (source) with turn t+1 (target) of the same
  conversation -> ``(conv_id, turn, src_text, tgt_text)``; with t+2 as pivot for 3-way rows.

Only the columns an operator needs are selected, so the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcorpus.functions.text import split_lines

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# tables whose rows carry CPU-heavy text (tokenising, n-grams)
TEXT_TABLES = {"documents", "conversations", "pages", "benchmark"}
#: Text of a task whose words are exploded into n-grams or attention cells: over 500 bytes of rows for each byte, measured.
TASK_TEXT = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        df = spread(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores (a small file
    with one row group is read by one task).  Inputs of several files are returned untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) == 1 and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def by_key(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Hash-partitioned by ``keys`` over a fixed number of tasks, which adaptive execution doesn't merge: joins, groupings and
    windows on the keys, or on these and more columns, then stay inside the tasks."""
    return df.repartition(tasks, *keys)


def text_tasks(df: DataFrame, text_col: str = "text", task_bytes: int = TASK_TEXT) -> int:
    """Tasks for work that makes many rows of each word: one for ``task_bytes`` of text, so that a task's share does not grow
    with the table, and no fewer than there are cores."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))


def document_lines(spark: SparkSession, sf_dir: str, cols=("lang",)) -> DataFrame:
    """One row per line of every document; ``line_no`` is 0-based inside the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", *cols, "text")
    return docs.select("doc_id", *cols, F.posexplode(split_lines("text")).alias("line_no", "text")) \
        .withColumn("line_no", F.col("line_no").cast("long"))


def conversation_pairs(spark: SparkSession, sf_dir: str, pivot: bool = False, bounded: bool = True) -> DataFrame:
    """Turn t as source, turn t+1 as target (inner positional join on (conv_id, turn)).

    The join key is the conversation and the turn number: a conversation is a handful of
    rows, so there is no hot key.  Both sides are partitioned by it over tasks of bounded text, so what
    follows on the pair (n-grams, attention cells) needs no further shuffle and fits a task's memory.
    With ``bounded`` off the planner deals the rows (EM's sums of doubles follow the order of the rows)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    key, tasks = ["conv_id", "turn"], text_tasks(conv) if bounded else 0
    place = lambda df: by_key(df, key, tasks) if bounded else df
    src = place(conv.select("conv_id", "turn", F.col("text").alias("src_text")))
    tgt = place(conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt_text")))
    out = src.join(tgt, ["conv_id", "turn"], "inner")
    if pivot:
        piv = place(conv.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("pivot_text")))
        out = out.join(piv, ["conv_id", "turn"], "left")
    return out

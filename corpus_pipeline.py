"""Documents to token ids: quality rules, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next stage.  All but the last return the columns of ``documents``; other columns of
their input pass through them, whatever their names (they travel in one struct, ``packed``).

Every stage takes empty tables, null or empty texts (no words, no bytes), null ids, very long texts and repeated
rows: only stage 2 merges rows, those equal in doc_id and text; ties there go to the smallest doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcorpus.llm import byte_bpe, jaccard_join, mixing, quality_rules, suffix_dedup
from seqcorpus.llm.common import small_batches, table, written
from seqcorpus.llm.queries import RANKS

#: Bytes of a repeated passage (stage 3): passages of over 50 words are longer, and op5's 400 would miss most of them.
PASSAGE = 200


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The ``used`` columns and all others in one struct, where no name can meet an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None)).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], **made: str) -> DataFrame:
    """``columns`` out of a packed table; ``made`` names the column that takes a column's place."""
    top = {c: c for c in df.columns if c in ("doc_id", "text", "source")} | made
    return df.select(*[F.col(top[c]).alias(c) if c in top else F.col("_rest").getField(c).alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality rules reject go.  The rules are learned from ``labels``."""
    rules = quality_rules.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(quality_rules.statistics(packed(docs, "doc_id", "text")), rules)
    return unpacked(judged.where("kept"), docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each component of near copies the smallest doc_id stays (of repeated rows, one)."""
    small_batches(spark)
    named = jaccard_join.near_duplicates(docs.select("doc_id", "text"))
    kept = named.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    left = packed(docs, "doc_id", "text").join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    return unpacked(left.dropDuplicates(["doc_id", "text"]), docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: bytes in strings of ``PASSAGE`` that occur elsewhere go; a document stays with what is left, and
    its n_chars follows."""
    small_batches(spark)
    left = suffix_dedup.remove_repeats(packed(docs, "doc_id", "text"), length=PASSAGE, as_text=True)
    return unpacked(left.withColumn("n_chars", F.length("kept").cast("long")), docs.columns, text="kept", n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents of smaller sources are repeated to the tempered weights; none goes."""
    return unpacked(mixing.mixed(packed(docs, "doc_id", "text", "source")), docs.columns)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: token ids and their character offsets."""
    small_batches(spark)
    return byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, offsets=True)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_documents),
]

#: Learned rules, components and encodings are no SQL: tests/llm/test_pages_vectors_pipeline.py has brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs

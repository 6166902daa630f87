"""Registered queries of the operators, with production parameters, and their DuckDB oracles."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcorpus.llm import byte_bpe, hard_negatives, html_extract, jaccard_join, lm_scoring, mixing, nearest, oracles, quality_classifier, quality_rules, sharding, suffix_dedup, vector_codes, warc
from seqcorpus.llm.common import shared_folder, small_batches, spread, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return byte_bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(spread(pages, "page_id"), html_extract.learn(pages))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    # the digest is of the remaining bytes; in the text a character that a cut went through is U+FFFD
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.apply_rules(quality_rules.statistics(spread(docs, "doc_id")), rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), lambda v: v % 20 == 0, k=20)


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=40)


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.stream(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.archive(warc.page_records(table(spark, sf_dir, "pages")), folder)
    return warc.index(spark, folder)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), lambda v: v % 100 == 0, label=label)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_ngram_jaccard_join, op3_weak_labels, op4_lm_scoring, op5_suffix_dedup, op6_quality_rules, op7_adaptive_scan, op8_feistel_shards, op9_byte_bpe, op10_temperature_mix, op11_warc, op12_hard_negatives, op13_vector_codes)}
ORACLES: dict[str, str] = {"op11_warc": oracles.OP11, "op12_hard_negatives": oracles.OP12, "op13_vector_codes": oracles.OP13}

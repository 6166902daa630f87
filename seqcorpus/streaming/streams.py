"""Structured Streaming forms: STR-01 (encode arriving lines), STR-02 (running word counts),
STR-03 (meters per event-time window with a watermark), STR-04 (micro-batch scoring with the
input order restored), STR-05 (resume = the query's checkpoint location).

Every query writes to files under a caller-given folder with its own checkpoint location, so a
restarted query continues where it stopped and a lost executor only replays its micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqcorpus.functions.text import split_lines, tokenize
from seqcorpus.operators import encode as enc


def table_stream(spark: SparkSession, folder: str, name: str, schema: str, max_files: int = 1) -> DataFrame:
    """``<name>*.parquet`` arriving in ``folder`` as a stream: files, or folders of part files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(f"{folder.rstrip('/')}/{name}*.parquet")


def document_line_stream(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """Documents arriving as parquet files, broken into lines."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = folder.rstrip("/").removesuffix("*")  # a pattern of written tables names their folder
    docs = table_stream(spark, folder, "documents", schema, max_files)
    return docs.select("doc_id", "lang", F.posexplode(split_lines("text")).alias("line_no", "text"))


def stream_encode(lines: DataFrame, vocab: DataFrame, out: str, checkpoint: str):
    """STR-01: encode with a frozen vocabulary (shipped once, vectorised lookup), append sink."""
    e = enc.encode_lines(lines, vocab, how="broadcast").drop("_tokens")
    return (e.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def stream_word_counts(lines: DataFrame, out: str, checkpoint: str):
    """STR-02: running counts per word in update mode; each micro-batch's changed rows are
    written to its own folder, which a replay overwrites (the newest row per word is the current count)."""
    counts = lines.select(F.explode(tokenize("text")).alias("symbol")).groupBy("symbol").count()

    def sink(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_meters(events: DataFrame, out: str, checkpoint: str, window: str = "1 hour", delay: str = "10 minutes"):
    """STR-03: weighted-average and rate meters per (event-time window, key); the watermark
    finalises a window so results are appended once."""
    m = (events.withWatermark("ts", delay)
         .groupBy(F.window("ts", window).alias("w"), "event_type")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("avg")))
    m = m.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "avg")
    return (m.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def stream_score(lines: DataFrame, score_fn, out: str, checkpoint: str, id_cols: list[str]):
    """STR-04: each micro-batch is scored by ``score_fn(batch) -> DataFrame`` and written sorted by
    the input ids (order holds inside a micro-batch)."""
    def sink(batch: DataFrame, batch_id: int):
        score_fn(batch).sortWithinPartitions(*id_cols).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()

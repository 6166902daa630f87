"""Streams against batch results, and a stream that is stopped, restarted and broken off in the middle of a batch."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from seqcorpus.streaming import streams as stm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
DOCS = [(i, f"a b{i % 4}\nc{i % 7} a", "en", "s", 10) for i in range(30)]


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame([(0, "<Lua heritage>"), (1, "<pad>"), (2, "</s>"), (3, "<unk>"), (4, "a"), (5, "b1"), (6, "c3")], "id int, symbol string")


def _arrive(spark, folder, k):
    spark.createDataFrame(DOCS[k * 10:k * 10 + 10], SCHEMA).coalesce(1).write.parquet(f"{folder}/in/documents-{k}.parquet")


def _encode(spark, folder, vocab):
    stm.stream_encode(stm.document_line_stream(spark, f"{folder}/in/*"), vocab, f"{folder}/out", f"{folder}/ckpt").awaitTermination()


def test_resume_after_stop(spark, tmp_path, vocab):
    folder = str(tmp_path)
    _arrive(spark, folder, 0)
    _encode(spark, folder, vocab)
    first = spark.read.parquet(f"{folder}/out").collect()
    assert sorted((r.doc_id, r.line_no) for r in first) == [(i, n) for i in range(10) for n in (0, 1)]
    _arrive(spark, folder, 1)
    _arrive(spark, folder, 2)
    _encode(spark, folder, vocab)
    _encode(spark, folder, vocab)  # nothing new: nothing is added
    got = spark.read.parquet(f"{folder}/out").collect()
    assert sorted((r.doc_id, r.line_no) for r in got) == [(i, n) for i in range(30) for n in (0, 1)]
    ids = {"a": 4, "b1": 5, "c3": 6}
    assert all(r.ids == [ids.get(w, 3) for w in DOCS[r.doc_id][1].split("\n")[r.line_no].split()] + [2] for r in got)


def test_resume_after_a_failure_in_a_batch(spark, tmp_path):
    """The sink of the second batch fails after it has written: the batch runs again and nothing counts twice."""
    folder, failed = str(tmp_path), []
    for k in range(3):
        _arrive(spark, folder, k)

    def score(batch):
        n = batch.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))
        if len(failed) == 1:
            failed.append("now")
            n.write.mode("overwrite").parquet(f"{folder}/out/batch_id=1")
            raise RuntimeError("lost")
        if not failed:
            failed.append("first batch done")
        return n

    def run():
        stm.stream_score(stm.document_line_stream(spark, f"{folder}/in/*"), score, f"{folder}/out", f"{folder}/ckpt", ["lang"]).awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    got = spark.read.parquet(f"{folder}/out").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.count_distinct("batch_id").alias("b")).first()
    assert (got.n, got.t, got.b) == (60, 2 * sum(range(30)), 3)


def test_running_counts_after_restart(spark, tmp_path):
    folder = str(tmp_path)
    for k in range(3):
        _arrive(spark, folder, k)
        lines = stm.document_line_stream(spark, f"{folder}/in/*")
        stm.stream_word_counts(lines, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    got = {r.symbol: r.n for r in spark.read.parquet(f"{folder}/out").groupBy("symbol").agg(F.max_by("count", "batch_id").alias("n")).collect()}
    words = [w for _, t, *_ in DOCS for w in t.split()]
    assert got == {w: words.count(w) for w in set(words)}


def test_meters_of_closed_windows(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i // 4:02d}:{15 * (i % 4):02d}:00", i % 3, "ab"[i % 2], float(i), "{}") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in/events-0.parquet")
    events = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
    stm.stream_meters(events, f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
    got = sorted((r.window_start.hour, r.event_type, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted((h, t, 2, sum(float(i) for i in range(4 * h, 4 * h + 4) if "ab"[i % 2] == t)) for h in range(9) for t in "ab")
    assert got == want


def test_tables_of_one_file_and_of_part_files(spark, tmp_path):
    """A table is a file or a folder of part files; a stream of it reads every row either way."""
    docs = spark.createDataFrame(DOCS, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/parts/documents.parquet")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one/written")
    os.rename(glob.glob(f"{tmp_path}/one/written/part-*.parquet")[0], f"{tmp_path}/one/documents.parquet")
    for kind in ("parts", "one"):
        at = f"{tmp_path}/{kind}"
        lines = stm.document_line_stream(spark, at)
        stm.stream_word_counts(lines, f"{at}/out", f"{at}/ckpt").awaitTermination()
        got = spark.read.parquet(f"{at}/out").where("symbol = 'a'").agg(F.max("count")).first()[0]
        assert got == sum(t.split().count("a") for _, t, *_ in DOCS)


def test_resume_query_writes_arrivals_in_parallel(spark, tmp_path):
    """str_05: an arrival is written by all tasks that hold its rows, not by one."""
    from seqcorpus.plans.corpora import q_resume_stream

    for k in range(6):
        spark.createDataFrame(DOCS[k * 5:k * 5 + 5], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    before = set(_arrivals(spark))
    got = q_resume_stream(spark, str(tmp_path)).select("doc_id", "line_no").collect()
    assert sorted(map(tuple, got)) == [(i, n) for i in range(30) for n in (0, 1)]
    folder, = set(_arrivals(spark)) - before
    assert all(len(glob.glob(f"{folder}/documents-{k}.parquet/part-*")) > 1 for k in range(3))


def _arrivals(spark):
    from seqcorpus.plans.session import scratch_path

    return glob.glob(f"{os.path.dirname(scratch_path(spark, 'x'))}/resume-*/in")

"""Operator 2: lists of any length have a signature.  Operator 5: periodic texts of any length."""

import numpy as np
from pyspark.sql import functions as F

from seqcorpus.llm import jaccard_join


def test_a_list_of_a_million_texts(spark):
    nodes = spark.range(1_000_000).select(F.xxhash64("id").alias("fp"))
    short = spark.createDataFrame([(5, 1), (5, 2), (6, 1), (6, 3), (7, 1)], "key long, fp long")
    shared = nodes.select(F.lit(1).cast("long").alias("key"), "fp").unionAll(nodes.select(F.lit(2).cast("long").alias("key"), "fp"))
    got = jaccard_join.different_lists(shared.unionAll(short)).collect()
    assert sorted((r.m, r.key) for r in got) == [(2, 5), (2, 6), (1_000_000, 1)]


def test_periodic_text_is_one_run():
    from seqcorpus.llm import suffix_dedup

    for period, rows in ((b"a", 1), (b"abc", 4), (b"the same line again\n", 22)):
        a = np.frombuffer(period * (100_000 // len(period)), np.uint8)
        row, start, n, _, _, times = suffix_dedup.runs_of(a, np.array([0, len(a)]), 400, 100)
        assert len(row) <= rows and (n * times).sum() == len(a) - 399 and start[0] == 0


def test_twenty_megabytes_of_one_letter(spark):
    import resource

    from seqcorpus.llm import suffix_dedup

    size = 20_000_000
    docs = spark.createDataFrame([(1, "a" * size), (2, "b" * 399 + "c"), (3, "ab" * 250), (4, "ba" * 225)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).drop("text").collect()}
    assert (got[1].n_removed, got[1].n_spans, bytes(got[1].kept)) == (size, 1, b"")
    assert got[2].n_removed == 0 and (got[3].n_removed, got[4].n_removed) == (500, 450)
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 8 << 20  # KB of any worker that has ended



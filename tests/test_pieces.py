"""Word pieces as arrays of a line against exploded ones."""

import math
import random

from pyspark.sql import functions as F

from seqcorpus.operators import scoring as sc
from seqcorpus.plans.registry import REGISTRY


def test_merged_arrays_equal_merged_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice(["a@@", "b", "é@@", "@@", "cd"]) for _ in range(rng.randint(0, 9))]) for i in range(300)] + [(None, ["a@@", "a@@"])]
    rows = [(k, p, [rng.choice([-0.5, -1.25, float("-inf")]) for _ in p]) for k, p in rows]
    nested = spark.createDataFrame(rows, "k int, piece array<string>, score array<double>").repartition(4)
    flat = nested.select("k", F.posexplode(F.arrays_zip("piece", "score")).alias("pos", "z")).select("k", "pos", "z.piece", "z.score")
    for operator in (sc.merge_bpe_scores, sc.word_probs):
        got = operator(nested, ["k"])
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, operator(flat, ["k"]).collect()), key=repr)
    assert "hashpartitioning" not in sc.word_probs(nested, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_word_probs_of_lines_whose_key_occurs_again(spark, tmp_path):
    docs = [(1, "house é \x1fab\nabcde\r\n", "en"), (2, "house houses", "de"), (2, "house houses", "de"), (None, "house", "en"), (3, None, "en"), (4, "", "en")]
    spark.createDataFrame([(d, t, l, "s", 0) for d, t, l in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, REGISTRY["win_11_word_probs"](spark, str(tmp_path)).collect()), key=repr)
    # pieces: hous@@ 6 (e 4, es 2), é 1, ab 1, abcd@@ 1, e 1 more
    lp = lambda c: math.log((c - 1) / 16)
    house, houses = round(lp(6) + lp(5), 6), round(lp(6) + lp(2), 6)
    assert [r for r in got if r[0] in (1, None)] == sorted([(1, 0, 0, "house", house, 2), (1, 0, 1, "é", None, 1), (1, 0, 2, "ab", None, 1),
                                                            (1, 1, 0, "abcde", None, 2), (None, 0, 0, "house", house, 2)], key=repr)
    again = [r for r in got if r[0] == 2]
    assert sum(r[5] for r in again) == 8 and len({r[2] for r in again}) == len(again)
    assert houses < 0

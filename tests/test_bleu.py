"""BLEU properties: identical lines score 100; clipping; short hypotheses; empty line = 1 token."""

import math

from seqcorpus.operators import bleu as bl


def _stats(spark, pairs):
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(pairs)], "pair int, ref array<string>, hyp array<string>")
    return bl.bleu_stats(df, ["pair"], "ref", "hyp")


def test_identity_is_100(spark):
    s = _stats(spark, [("a b c d e".split(), "a b c d e".split())])
    assert bl.corpus_bleu(s).first().bleu == 100.0


def test_clipping_and_counts(spark):
    s = _stats(spark, [("the cat".split(), "the the the".split()), ([], []), ("x y z w".split(), ["x"])]).orderBy("pair").collect()
    assert (s[0].match1, s[0].count1, s[0].count2) == (1, 3, 2)
    assert (s[1].reflen, s[1].predlen, s[1].match1) == (1, 1, 1)  # empty line counts one token
    assert (s[2].count2, s[2].match2, s[2].reflen) == (0, 0, 4)


def test_unk_in_reference_never_matches(spark):
    s = _stats(spark, [(["<unk>", "a"], ["<unk>", "a"])]).first()
    assert s.match1 == 1


def test_score_formula(spark):
    s = _stats(spark, [("a b c d e f".split(), "a b c d x".split())])
    r = bl.corpus_bleu(s).first()
    p = [4 / 5, 3 / 4, 2 / 3, 1 / 2]
    want = math.exp(1 - 6 / 5) * math.exp(sum(map(math.log, p)) / 4) * 100
    assert abs(r.bleu - want) < 1e-5
    assert bl.bleu_report(bl.corpus_bleu(s)).first().report.startswith("BLEU4 = ")


def test_multi_ref_counts_and_plan(spark):
    """Clipped by the largest count over the references, repeated keys added up; no n-gram goes through a shuffle."""
    hyps = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["x"]), (3, []), (4, ["q", "q"]), (4, ["q"])], "k long, hyp array<string>")
    refs = spark.createDataFrame([(1, 0, ["a", "c"]), (1, 1, ["A", "a", "a", "b"]), (2, 0, ["y"]), (4, 0, ["q"]), (4, 0, ["q", "z"])], "k long, ref_no int, ref array<string>")
    got = bl.multi_ref_bleu(hyps, refs, ["k"], "hyp", "ref", tasks=3)
    rows = sorted((r.k, r.predlen, r.reflen, r.match1, r.count1, r.match2, r.count2, r.match3, r.count3) for r in got.collect())
    assert rows == [(1, 3, 2, 3, 3, 2, 2, 1, 1), (2, 1, 1, 0, 1, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0, 0, 0), (4, 1, 1, 2, 3, 0, 1, 0, 0), (4, 2, 1, 2, 3, 0, 1, 0, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and " g#" in x]


def test_pairs_stay_in_tasks_of_bounded_text(spark, tmp_path, monkeypatch):
    """More text, more tasks; the n-grams and attention cells of a pair need no shuffle after the pairing join."""
    from seqcorpus.plans import catalog as cat
    from seqcorpus.sources import tables

    rows = [(c, t, "user", f"w{c} w{t} w{c} a") for c in range(40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(tables.text_tasks, "__defaults__", ("text", 50))
    tasks = tables.text_tasks(spark.read.parquet(f"{tmp_path}/conversations.parquet"))
    assert tasks == -(-sum(len(r[3]) for r in rows) // 50) > spark.sparkContext.defaultParallelism
    for query in (cat.q_clip, cat.q_head_avg):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert shuffles and all(f" {tasks})" in x and "REPARTITION_BY_NUM" in x for x in shuffles)

"""Cases that once came out wrong, and golden rows of scoring and checkpoints."""

import math

import pytest
from pyspark.sql import functions as F

from seqcorpus.functions import arrays as A
from seqcorpus.operators import align, bleu, blocks, checkpoints, scoring
from seqcorpus.plans.keys import digit_widths, packed_key, unpack_key
from seqcorpus.sources import files


@pytest.mark.parametrize("rows", [[(5, 999, 9999), (6, 0, 0), (0, 0, 1)], [(10**18 + 7, 10**5 + 3, 99_999_999), (10**18 + 6, 10**5 + 4, 0)]])
def test_packed_keys(spark, rows):
    df = spark.createDataFrame(rows, "a long, b long, c long")
    widths = digit_widths(df, ["a", "b", "c"])
    got = df.withColumn("k", packed_key(["a", "b", "c"], widths)).orderBy("k").select(*unpack_key("k", widths, ["x", "y", "z"])).collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_vocabulary_in_several_part_files(spark, tmp_path):
    vocab = spark.createDataFrame([(4 + i, f"w {i}", 100 - i) for i in range(36)], "id int, symbol string, count long").repartition(4)
    path = f"file://{tmp_path}/vocab"
    vocab.repartitionByRange(4, "id").sortWithinPartitions("id").select(F.concat_ws(" ", "symbol", F.col("count").cast("string"))).write.text(path)
    got = files.read_vocab(spark, path).collect()
    assert sorted((r.id, r.symbol, r["count"]) for r in got if r.id >= 4) == [(4 + i, f"w {i}", 100 - i) for i in range(36)]
    assert len(got) == 40


def test_embeddings_and_lexicon_in_several_part_files(spark, tmp_path):
    lines = ["3 2", *[f"w{i} {i}.5 1.0" for i in range(20)], "w3 9.0 9.0"]
    spark.createDataFrame(list(enumerate(lines)), "i long, t string").repartitionByRange(3, "i").sortWithinPartitions("i").select("t").write.text(f"file://{tmp_path}/emb")
    got = {r.symbol: list(r.vector) for r in files.read_embeddings(spark, f"file://{tmp_path}/emb").collect()}
    assert len(got) == 20 and got["w3"] == [9.0, 9.0]


def test_checkpoint_names(spark):
    names = spark.createDataFrame([(f"checkpoint{i}.pt",) for i in (1, 2, 3, 10)] + [("checkpoint_best.pt",), ("checkpoint_last.pt",), ("xcheckpoint9.pt",)], "name string")
    assert [r.epoch for r in checkpoints.last_n_checkpoints(names, 2).collect()] == [10, 3]
    assert sorted(r.epoch for r in checkpoints.prune_old_checkpoints(names, 2).collect()) == [1, 2]
    assert [r.epoch for r in checkpoints.last_n_checkpoints(names, 1, upper=9).collect()] == [3]
    with pytest.raises(ValueError):
        checkpoints.last_n_checkpoints(names, 5)


def test_pretrained_flag(spark):
    vocab = spark.createDataFrame([(4, "a"), (5, "b")], "id int, symbol string")
    emb = spark.createDataFrame([("a", [1.0, 2.0])], "symbol string, vector array<double>")
    got = {r.symbol: (r.pretrained, list(r.vector)) for r in checkpoints.attach_embeddings(vocab, emb, 2).collect()}
    assert got == {"a": (True, [1.0, 2.0]), "b": (False, [0.0, 0.0])}


def test_average_checkpoints_golden(spark):
    # fixed values
    rows = [(0, 0, "a", [100.0], False), (1, 0, "a", [1.0], False), (0, 1, "b", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], False), (1, 1, "b", [1.0] * 6, False),
            (0, 2, "c", [7.0, 8.0, 9.0], True), (1, 2, "c", [2.0, 2.0, 2.0], True)]
    got = {r.param: list(r.vector) for r in checkpoints.average_checkpoints(
        spark.createDataFrame(rows, "checkpoint int, param_no int, param string, vector array<double>, is_int boolean")).collect()}
    assert got == {"a": [50.5], "b": [1.0, 1.5, 2.0, 2.5, 3.0, 3.5], "c": [4.0, 5.0, 5.0]}


def test_label_smoothing_golden(spark):
    # fixed values: probabilities of a vocabulary of seven
    probs = [[.05, .05, .1, .05, .3, .4, .05], [.05, .10, .2, .05, .2, .3, .10], [.05, .15, .3, .05, .1, .2, .15]]
    targets = [(0, 0, 4), (0, 1, 2), (1, 0, 4), (1, 1, 4), (1, 2, 2)]
    model = spark.createDataFrame([(p, t, math.log(x)) for p, row in enumerate(probs) for t, x in enumerate(row)], "ctx int, token int, lp double")
    unseen = spark.createDataFrame([(p, 7, -50.0) for p in range(3)], "ctx int, n_seen int, lp0 double")
    scored = spark.createDataFrame([(s, p, t, p, math.log(probs[p][t]), 0) for s, p, t in targets], "sample int, pos int, token int, ctx int, lp double, g int")
    for eps in (0.0, 0.1):
        nll = -sum(math.log(probs[p][t]) for _, p, t in targets)
        smooth = -sum(math.log(x) for _, p, _ in targets for x in probs[p]) / 7
        loss = (1 - eps) * nll + eps * smooth
        a = scoring.label_smoothed_loss(scored, unseen, model, 7, eps, ["g"]).first()
        b = scoring.label_smoothed_loss(scored, unseen, model, 7, eps, ["g"], sentence_avg=True, sentence_cols=["sample"]).first()
        assert math.isclose(a.nll, nll) and math.isclose(a.loss, loss) and math.isclose(a.loss_bits, loss / 5 / math.log(2))
        assert math.isclose(b.loss_bits, loss / 2 / math.log(2)) and math.isclose(b.nll_bits, a.nll_bits)


def test_bands(spark):
    head, band, tail = A.band_labels("t", [3, 6], 10)
    got = [tuple(r) for r in spark.range(10).select(F.col("id").cast("int").alias("t")).select("t", head, band, tail).orderBy("t").collect()]
    assert got == [(0, 0, 0, None), (1, 1, 0, None), (2, 2, 0, None), (3, 2, 1, 0), (4, 2, 1, 1), (5, 2, 1, 2), (6, 3, 2, 0), (7, 3, 2, 1), (8, 3, 2, 2), (9, 3, 2, 3)]
    with pytest.raises(ValueError):
        A.band_labels("t", [3, 20], 10)


def test_bleu_side(spark):
    cases = [(["<pad>", "<pad>", "a", "b", "<pad>", "</s>"], ["a", "b"]), ([], ["</s>"]), (["<pad>"], ["</s>"]), (["a", "</s>", "b"], ["a", "</s>", "b"]), (["</s>", "<pad>"], ["</s>"])]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, t array<string>")
    got = [list(r.x) for r in df.select("i", bleu.bleu_side("t", False).alias("x")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_bigram_counts_are_made_once(spark):
    """Model, unseen and all their uses read the written counts; the positions aren't counted again."""
    from pyspark.sql import functions as F
    from seqcorpus.operators import scoring as sc

    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    lines = spark.createDataFrame([(i, [4 + i % 3, 5, 2]) for i in range(20)], "k long, ids array<int>").mapInArrow(seen, "k long, ids array<int>")
    model, unseen = sc.bigram_model(sc.positions(lines, ["k"]), 10)
    assert model.count() and unseen.count() and sc.argmax_token(model).count()
    assert runs.value == 20
    assert abs(model.where("ctx = 5 AND token = 2").select(F.exp("lp")).first()[0] - 21 / 37) < 1e-9


def _attention_tables(spark):
    keys = [(1, 0), (1, 0), (1, 1), (2, 0), (None, 0)]  # a pair twice, a null key
    tp = [(c, t, i, j, w) for c, t in keys for i in range(4) for j, w in ((i, 0.5), (i + 1, 0.25), (i + 2, 0.15), (i + 3, 0.1))]
    ps = [(c, t, j, j // 2 + d, 0.6 - d / 2) for c, t in keys[1:] for j in range(5) for d in (0, 1)]
    schema = "conv_id long, turn int, tgt_pos int, src_pos int, weight double"
    return spark.createDataFrame(tp, schema), spark.createDataFrame(ps, schema)


def test_relay_and_loss_keep_the_partitioning_by_pair(spark):
    key, cell = ["conv_id", "turn"], ["conv_id", "turn", "tgt_pos", "src_pos"]
    tp, ps = (x.repartition(5, *key) for x in _attention_tables(spark))
    relayed = align.attention_relay(tp, ps, key)
    # by joins on the positions
    top = align.topk_positions(tp, key, 3).select(*key, "tgt_pos", F.col("src_pos").alias("pivot_pos"))
    hard = align.hard_alignment(ps, key).select(*key, F.col("tgt_pos").alias("pivot_pos"), "src_pos")
    want = top.join(hard, [*key, "pivot_pos"]).select(*cell).distinct()
    rows = sorted(map(tuple, relayed.select(*cell).collect()))
    assert rows == sorted(map(tuple, want.collect())) and rows and {r.weight for r in relayed.collect()} == {0.3}
    lone = spark.createDataFrame([(None, 0, 0, 0, 0.3), (9, 9, 0, 0, None)], tp.schema)
    other = relayed.unionByName(relayed.where("tgt_pos = 1")).unionByName(lone)
    j = tp.withColumnRenamed("weight", "s").join(other.withColumnRenamed("weight", "r"), cell, "full_outer")
    d = F.coalesce("s", F.lit(0.0)) - F.coalesce("r", F.lit(0.0))
    assert align.attention_teaching_loss(tp, other, key).first().loss == pytest.approx(j.agg(F.sqrt(F.sum(d * d))).first()[0])
    assert align.attention_teaching_loss(tp.dropna().dropDuplicates(cell), tp.dropna().dropDuplicates(cell), key).first().loss == 0.0
    for df, more in ((relayed, 0), (align.attention_teaching_loss(tp, relayed, key), 1)):  # the loss ends in one row
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange SinglePartition") == more and "Join" not in plan
        assert all(x.startswith("(conv_id#") and ", 5), REPARTITION" in x.split("\n")[0] for x in plan.split("Exchange hashpartitioning")[1:])


def test_chain_of_many_chunks_has_a_small_plan(spark):
    n = 70
    table = spark.createDataFrame([("a", c, c * 10 + e, (c + 1) * 10 + (e + c) % 3, 2 + e) for c in range(n) for e in range(3)],
                                  "lang string, _chunk long, entry long, exit long, nblocks long")
    got = blocks.chunk_entries(table, "lang")
    want, at, before = [], 0, 0
    for c in range(n):
        want.append((c, at, before))
        e = at - c * 10
        at, before = (c + 1) * 10 + (e + c) % 3, before + 2 + e
    assert sorted((r._chunk, r._entry, r._boff) for r in got.collect() if r._chunk < n) == want
    assert got._jdf.queryExecution().executedPlan().toString().count("Join") <= 2

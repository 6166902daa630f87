"""Queries without a SQL oracle, and model scoring, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcorpus.functions import text as tx
from seqcorpus.operators import batching as bt
from seqcorpus.operators import bleu as bl
from seqcorpus.operators import logs as lg
from seqcorpus.operators import model_scoring as ms
from seqcorpus.operators import scoring as sc
from seqcorpus.plans.registry import REGISTRY
from seqcorpus.sources import files as fs
from seqcorpus.sources import parallel as par

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_rouge_l(spark):
    rng = random.Random(1)
    pairs = [(i, [rng.choice("abcde") for _ in range(rng.randint(0, 90))], [rng.choice("abcdf") for _ in range(rng.randint(0, 90))]) for i in range(60)]
    pairs += [(100, [], []), (101, ["a"] * 70, ["a"] * 65), (102, ["a"], ["b"])]
    df = spark.createDataFrame(pairs, "k int, ref array<string>, hyp array<string>")
    for r in bl.rouge_l(df, ["k"], "ref", "hyp").collect():
        ref, hyp = next((a, b) for k, a, b in pairs if k == r.k)
        n = lcs(ref, hyp)
        rec, prec = n / len(ref) if ref else 0.0, n / len(hyp) if hyp else 0.0
        assert r.lcs == n and r.recall == pytest.approx(rec) and r.precision == pytest.approx(prec)
        assert r.f1 == pytest.approx(2 * rec * prec / (rec + prec) if rec + prec else 0.0)


def test_epoch_shuffle_and_resume(spark):
    batches = spark.range(57).select(F.col("id").alias("batch_id"))
    order = {e: [r.batch_id for r in bt.epoch_shuffle(batches, 1, e).orderBy("epoch_ord").collect()] for e in (3, 4)}
    again = [r.batch_id for r in bt.epoch_shuffle(batches.repartition(7), 1, 3).orderBy("epoch_ord").collect()]
    assert sorted(order[3]) == list(range(57)) and order[3] == again and order[3] != order[4] != list(range(57))
    shuffled = bt.epoch_shuffle(batches, 1, 3)
    left = bt.resume_position(shuffled, 5, 3).orderBy("epoch_ord").collect()
    assert [r.batch_id for r in left] == order[3][5:] and {(r.epoch, r.offset) for r in left} == {(3, 5)}
    nxt = bt.resume_position(shuffled, 57, 3).collect()
    assert len(nxt) == 57 and {(r.epoch, r.offset) for r in nxt} == {(4, 0)}


LOG = [
    ("| epoch 001:   1000 / 3233 loss=9.5, nll_loss=8.1, ppl=278.00, num_updates=1000, wall=120", ("train_inner", 1, 1000, 3233, None, 9.5, 278.0, 1000, 120)),
    ("| epoch 002 | loss 7.125 | nll_loss 6.0 | ppl 64.00 | num_updates 6466 | wall 300", ("train", 2, None, None, None, 7.125, 64.0, 6466, 300)),
    ("| epoch 002 | valid on 'valid' subset | valid_loss 6.5 | valid_ppl 90.51 | num_updates 6466", ("valid", 2, None, None, "valid", 6.5, 90.51, 6466, None)),
    ('{"epoch": 3, "loss": "5.5", "num_updates": "9", "wall": "11"}', ("json", None, None, None, None, 5.5, None, 9, 11)),
    ("| model parameters: 59498496", None), ("Killed", None), ("", None),
]


def test_train_log(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LOG)], "i int, text string")
    got = {r.i: (r.kind, r.epoch, r.step, r.total, r.subset, r.loss, r.ppl, r.num_updates, r.wall) for r in lg.parse_train_log(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LOG) if want}


def test_running_best(spark):
    rng = random.Random(2)
    rows = [(u, n, float(rng.randint(1, 9))) for u in range(6) for n in range(rng.randint(1, 12))]
    got = {(r.u, r.n): (r.best_so_far, r.is_best) for r in lg.running_best(spark.createDataFrame(rows, "u int, n int, loss double"), ["u"], "n").collect()}
    for u, n, loss in rows:
        before = [x for v, m, x in rows if v == u and m < n]
        assert got[u, n] == (min([loss, *before]), not before or loss < min(before))


def test_synthetic_lines(spark):
    lines = {r.line_no: r.text for r in fs.synthetic_corpus(spark, 400, 20, 42).collect()}
    assert len(lines) == 400 and lines == {r.line_no: r.text for r in fs.synthetic_corpus(spark, 400, 20, 42).repartition(3).collect()}
    sizes = [len(t.split(" ")) for t in lines.values()]
    assert set(sizes) == set(range(1, 21)) and all(len(w) == 1 and "a" <= w <= "z" for t in lines.values() for w in t.split(" "))
    assert {r.line_no: r.text for r in fs.synthetic_corpus(spark, 400, 20, 43).collect()} != lines


def test_punctuation_rule(spark):
    """Control, format and unassigned code points become blanks; then the listed signs are replaced, then runs of blanks shrink."""
    import unicodedata

    texts = ["„a“ – b…", "x\u0000y​z", "it’s  ‘q’ `w` ''e''", "a—b c", "", "plain", "tab\tend‮", "«é» ‚"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", tx.normalize_punct(tx.strip_nonprinting("t")).alias("out")).collect():
        want = "".join(" " if unicodedata.category(c).startswith("C") else c for c in texts[r.i])
        for a, b in tx.PUNCT_REPLACEMENTS:
            want = want.replace(a, b)
        while "  " in want:
            want = want.replace("  ", " ")
        assert r.out == want


def test_characters_to_numbers(spark):
    """The query's ids: characters by falling count, ties by first place, from 4 on; 3 is unknown."""
    import hashlib
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    lines = {(r.doc_id, n): [c for c in t if not c.isspace()] for r in docs for n, t in enumerate(re.split("\r\n|\r|\n", r.text))}
    count, first = {}, {}
    for key in sorted(lines):
        for pos, c in enumerate(lines[key]):
            count[c] = count.get(c, 0) + 1
            first.setdefault(c, (key, pos))
    ids = {c: 4 + i for i, c in enumerate(sorted(count, key=lambda c: (-count[c], first[c])))}
    want = {k: hashlib.md5(" ".join(str(ids[c]) for c in cs).encode()).hexdigest() for k, cs in lines.items()}
    got = {(r.doc_id, r.line_no): r.ids_md5 for r in REGISTRY["prj_19_words_to_numbers"](spark, SF).collect()}
    assert got == want


# --- fixed values: targets and probabilities of a toy model (w1 = 4, w2 = 5, eos = 2) ---------------
TARGETS = [[4, 5, 4, 2], [5, 4, 2], [5, 2]]
PROBS = [  # by position: for each sample the probabilities of ids 2 to 5
    [[0.0, 0, 0.6, 0.4], [0.0, 0, 0.4, 0.6], [0.0, 0, 0.7, 0.3]],
    [[0.0, 0, 0.2, 0.7], [0.0, 0, 0.8, 0.2], [0.7, 0, 0.1, 0.2]],
    [[0.10, 0, 0.5, 0.4], [0.15, 0, 0.15, 0.7], [0.0, 0, 0.0, 0.0]],
    [[0.9, 0, 0.05, 0.05], [0.0, 0, 0.0, 0.0], [0.0, 0, 0.0, 0.0]],
]
EXPECTED = [[0.6, 0.7, 0.5, 0.9], [0.6, 0.8, 0.15], [0.3, 0.7]]


def test_score_reference_fixed_values(spark):
    df = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(TARGETS)] + [(8, [], [0]), (9, None, [0])], "sample int, ids array<int>, src array<int>")
    probs = PROBS

    def load_model():
        def model(batch):
            rows, length = batch["target"].shape
            out = np.full((rows, length, 6), -np.inf)
            for r in range(rows):
                for t in range(min(length, len(probs))):
                    with np.errstate(divide="ignore"):
                        out[r, t, 2:] = np.log(np.array(probs[t][int(batch["source"][r, 0])]))
            return out
        return model

    scored = ms.score_reference(df, ["sample"], load_model, source="src")
    got = {r.sample: r.lps for r in scored.collect()}
    assert {k: [round(math.exp(x), 6) for x in v] for k, v in got.items()} == {0: EXPECTED[0], 1: EXPECTED[1], 2: EXPECTED[2], 8: [], 9: []}
    total = {r.sample: r.score for r in sc.sequence_score(ms.positional(scored, ["sample"]), ["sample"]).collect()}
    assert total == pytest.approx({i: sum(map(math.log, p)) / len(p) for i, p in enumerate(EXPECTED)})


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load_model():
        import os
        import uuid
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda batch: -batch["target"].astype(float) - 0.5 * (batch["prev"] == 2)

    rows = [(i, [4 + i % 5] * (1 + i % 17) + [2]) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(24)
    scored = ms.score_reference(df, ["k"], load_model, max_tokens=64)
    for _ in range(2):
        got = {r.k: r.lps for r in scored.collect()}
    assert got == {k: [-float(t) - (0.5 if i == 0 else 0.0) for i, t in enumerate(ids)] for k, ids in rows}
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids)), "a worker loads the model once, over all tasks and jobs"


def test_lm_order(spark):
    import numpy as np

    sizes = [5, 3, 3, 9, 1, 3, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, size int").repartition(3)
    for mirrored in (False, True):
        got = [r.idx for r in bt.lm_order(df, ["i"], mirrored=mirrored).orderBy("ord").collect()]
        key = np.flip(np.array(sizes), 0) if mirrored else np.array(sizes)
        assert got == np.lexsort([np.arange(len(sizes)), key]).tolist()


def test_concat_corpora(spark):
    a = spark.createDataFrame([("en", 1, "x"), ("en", 2, "y"), ("de", 1, "z")], "lang string, k int, text string")
    b = spark.createDataFrame([("de", 0, "p"), ("en", 0, "q"), ("fr", 5, "r")], "lang string, k int, text string")
    got = sorted((r.lang, r.line, r.text) for r in par.concat_corpora([a, b], ["lang"], ["k"]).collect())
    assert got == [("de", 0, "z"), ("de", 1, "p"), ("en", 0, "x"), ("en", 1, "y"), ("en", 2, "q"), ("fr", 0, "r")]


def test_collate_four_way(spark):
    rows = [(0, 0, [4, 5, 2], [6, 2], [7, 2], None), (1, 0, [4, 2], [6, 7, 2], [7, 8, 9, 2], [5, 2]), (2, 1, [9, 2], [2], [2], [2])]
    df = spark.createDataFrame(rows, "k int, batch_id long, src_ids array<int>, tgt_ids array<int>, p array<int>, m array<int>")
    got = {r.k: r for r in bt.collate(df, id_cols=["k"], others={"p": "pivot", "m": "mt"}).collect()}
    assert got[0].source == [4, 5, 2] and got[1].source == [1, 4, 2] and got[1].row_in_batch == 1
    assert got[0].target == [6, 2, 1] and got[0].prev_output == [2, 6, 1]
    assert (got[0].pivot, got[1].pivot, got[2].pivot) == ([7, 2, 1, 1], [7, 8, 9, 2], [2])
    assert (got[0].mt, got[1].mt, got[2].mt) == ([1, 1], [5, 2], [2])


def test_post_process(spark):
    vocab = spark.createDataFrame([(0, "<Lua heritage>"), (1, "<pad>"), (2, "</s>"), (3, "<unk>"), (4, "we"), (5, "un@@"), (6, "do")], "id int, symbol string")
    hyps = spark.createDataFrame([(1, [4, 3, 5, 6, 2], ["wir", "Haus", "tun"], [0, 1, 2, 2]), (2, [3, 2], ["Baum"], [1]), (3, [2], ["x"], [0])],
                                 "k int, ids array<int>, src_tokens array<string>, alignment array<int>")
    lexicon = spark.createDataFrame([("Haus", "house")], "src string, tgt string")
    got = {r.k: (r.text, r.tokens) for r in sc.post_process(hyps, ["k"], vocab, lexicon).collect()}
    assert got == {1: ("we house un@@ do", ["we", "house", "un@@", "do"]), 2: ("<eos>", ["<eos>"]), 3: ("", [])}
    plain = {r.k: r.text for r in sc.post_process(hyps, ["k"], vocab, bpe_symbol="@@ ").collect()}
    assert plain == {1: "we <unk> undo", 2: "<unk>", 3: ""}


def test_own_tokenizer_and_own_sums(spark):
    from seqcorpus.operators import encode as enc

    vocab = spark.createDataFrame([(4, "a"), (5, "b c")], "id int, symbol string")
    lines = spark.createDataFrame([(1, "a;b c;d"), (2, "")], "k int, text string")
    own = F.pandas_udf(lambda s: s.map(lambda t: t.split(";") if t else []), "array<string>")
    assert {r.k: r.ids for r in enc.encode_lines(lines, vocab, tokenizer=own).collect()} == {1: [4, 5, 3, 2], 2: [2]}
    stats = enc.encode_stats(lines, vocab, ["k"], tokenizer=lambda c: F.filter(F.split(c, ";"), lambda x: x != "")).orderBy("k").collect()
    assert [(r.nseq, r.ntok, r.nunk) for r in stats] == [(1, 4, 1), (1, 1, 0)]
    logs = spark.createDataFrame([(1, 2.0, 3), (1, 4.0, 5)], "update int, hits double, n int")
    got = lg.aggregate_logs(logs, ["update"], ["hits", "n"], {"rate": F.col("hits") / F.col("n")}).first()
    assert (got.hits, got.n, got.rate) == (6.0, 8, 0.75)

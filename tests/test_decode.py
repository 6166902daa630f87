"""Beam search against the expected hypotheses (fixed values of a toy model), samples against a plain version."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from seqcorpus.operators import decode as dec

# --- fixed values: probabilities of eos, unk, w1, w2 by step and (sentence, beam) ---------------
EOS, UNK, W1, W2 = 2, 3, 4, 5
PROBS = [
    [[0.0, 0.0, 0.9, 0.1], [0.0, 0.0, 0.9, 0.1], [0.0, 0.0, 0.7, 0.3], [0.0, 0.0, 0.7, 0.3]],
    [[1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.9, 0.1], [0.25, 0.0, 0.35, 0.4], [0.00, 0.0, 0.10, 0.9]],
    [[0.0, 0.0, 0.1, 0.9], [0.6, 0.0, 0.2, 0.2], [0.60, 0.0, 0.4, 0.00], [0.01, 0.0, 0.0, 0.99]],
    [[1.0, 0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.1, 0.0, 0.5, 0.4], [1.0, 0.0, 0.0, 0.0]],
]


class BySlot:
    """A model whose probabilities depend on step, sentence and beam; after the listed steps eos is certain."""

    def __init__(self, spark):
        lp = lambda p: math.log(p) if p else float("-inf")
        rows = [(t, row // 2, row % 2, EOS + i, lp(p)) for t, table in enumerate(PROBS) for row, ps in enumerate(table) for i, p in enumerate(ps)]
        rows += [(t, sent, slot, EOS, 0.0) for t in range(4, 8) for sent in (0, 1) for slot in (0, 1)]
        self.table = spark.createDataFrame(rows, "at int, of int, beam int, token int, lp double")

    def best(self, beams, step, width):
        on = (F.col("of") == F.col("sent")) & (F.col("beam") == F.col("slot")) & (F.col("at") == step)
        return beams.join(self.table, on).select(*beams.columns, "token", "lp")

    def given(self, beams, step, token):
        return self.best(beams, step, 0).where(F.col("token") == F.col(token))


CASES = {
    "normalised": ({}, [[[W1, EOS], [W2, W1, W2, EOS]], [[W1, W2, W1, EOS], [W1, W2, EOS]]]),
    "unnormalised": ({"normalize": False}, [[[W1, EOS], [W2, W1, W2, EOS]], [[W1, W2, EOS], [W1, W2, W1, EOS]]]),
    "short": ({"lenpen": 0.6}, [[[W1, EOS], [W2, W1, W2, EOS]], [[W1, W2, EOS], [W1, W2, W1, EOS]]]),
    "long": ({"lenpen": 5.0}, [[[W2, W1, W2, EOS], [W1, EOS]], [[W1, W2, W1, EOS], [W1, W2, EOS]]]),
    "maxlen": ({"maxlen": 2}, [[[W1, EOS], [W2, W2, EOS]], [[W1, W2, EOS], [W2, W2, EOS]]]),
    "late": ({"stop_early": False}, [[[W1, EOS], [W2, W1, W2, EOS]], [[W2, W2, W2, W2, EOS], [W1, W2, W1, EOS]]]),
}
# --- fixed values: positional probabilities of the expected hypotheses, by sentence ---------------
POSITIONAL = [
    {(W1, EOS): [0.9, 1.0], (W2, W1, W2, EOS): [0.1, 0.9, 0.9, 1.0], (W2, W2, EOS): [0.1, 0.1, 0.6]},
    {(W1, W2, W1, EOS): [0.7, 0.4, 0.4, 1.0], (W1, W2, EOS): [0.7, 0.4, 0.6], (W2, W2, EOS): [0.3, 0.9, 0.01], (W2, W2, W2, W2, EOS): [0.3, 0.9, 0.99, 0.4, 1.0]},
]


@pytest.mark.parametrize("case", CASES)
def test_expected_hypotheses(spark, case):
    options, want = CASES[case]
    sents = spark.createDataFrame([(0,), (1,)], "sent int")
    got = dec.beam_decode(sents, BySlot(spark), ["sent"], k=2, **({"maxlen": 20} | options)).collect()
    for sent in (0, 1):
        rows = sorted((r for r in got if r.sent == sent), key=lambda r: r["rank"])
        assert [r.tokens for r in rows] == want[sent]
        for r in rows:
            lp = [math.log(p) for p in POSITIONAL[sent][tuple(r.tokens)]]
            assert r.positional == pytest.approx(lp, abs=1e-6)
            norm = 1.0 if options.get("normalize") is False else len(lp) ** options.get("lenpen", 1.0)
            assert r.score == pytest.approx(sum(lp) / norm, abs=1e-6)


BIGRAM = {2: {4: -0.5, 5: -1.0, 6: -2.0}, 4: {2: -1.5, 5: -0.25, 6: -2.0}, 5: {4: -0.75, 2: -1.0, 6: -1.0}, 6: {5: -0.5}}


def _table(spark):
    return dec.Transitions(spark.createDataFrame([(c, t, lp) for c, n in BIGRAM.items() for t, lp in n.items()], "ctx int, token int, lp double"))


def plain_beam(prefix, k, maxlen):
    """Early stopping, normalised by length, over the bigram table."""
    beams, done = [([], [])], []
    for t in range(maxlen + 1):
        cands = []
        for slot, (toks, cums) in enumerate(beams):
            nexts = BIGRAM.get(toks[-1] if toks else 2, {})
            if t == maxlen:
                nexts = {2: nexts.get(2, float("-inf"))}
            elif t < len(prefix):
                nexts = {prefix[t]: nexts.get(prefix[t], float("-inf"))}
            cands += [((cums[-1] if cums else 0.0) + lp, slot, tok) for tok, lp in nexts.items()]
        cands = sorted(cands, key=lambda c: (-c[0], c[1], c[2]))[:2 * k]
        for cum, slot, tok in cands[:k]:
            if tok == 2 and t >= 1 and len(done) < k:
                done.append((cum / (t + 1), beams[slot][0] + [2]))
        if len(done) == k:
            break
        beams = [(beams[s][0] + [tok], beams[s][1] + [cum]) for cum, s, tok in cands if tok != 2 and cum > float("-inf")][:k]
    return sorted(done, key=lambda d: -d[0])


@pytest.mark.parametrize("k,maxlen", [(1, 3), (2, 5), (3, 2), (4, 7)])
def test_beam_against_plain_version(spark, k, maxlen):
    prefixes = {0: None, 1: [], 2: [6], 3: [5, 4], 4: [6, 6], 5: [9]}
    sents = spark.createDataFrame(list(prefixes.items()), "id int, p array<int>")
    got = dec.beam_decode(sents, _table(spark), ["id"], k=k, maxlen=maxlen, prefix="p").collect()
    for i, prefix in prefixes.items():
        rows = sorted((r for r in got if r.id == i), key=lambda r: r["rank"])
        assert [(round(r.score, 9), r.tokens) for r in rows] == [(round(s, 9), t) for s, t in plain_beam(prefix or [], k, maxlen)]


def test_no_sentences(spark):
    assert dec.beam_decode(spark.createDataFrame([], "id int"), _table(spark), ["id"], k=2, maxlen=3).collect() == []


def _noise(seed, i, sample, step, token):
    h = int(hashlib.md5(f"{seed}|{i}|{sample}|{step}|{token}".encode()).hexdigest()[:12], 16)
    return -math.log(-math.log((h + 0.5) / 2**48))


def test_samples_against_plain_version(spark):
    ids, n, temperature, seed = range(6), 3, 0.8, 5
    got = dec.topk_sample(spark.createDataFrame([(i,) for i in ids], "id int"), _table(spark), ["id"], n=n, k=2, temperature=temperature, maxlen=10, seed=seed)
    rows = {(r.id, r.sample): r for r in got.collect()}
    again = {(r.id, r.sample): r for r in got.repartition(5).collect()}
    assert rows == again and len(rows) == 18
    for (i, s), r in rows.items():
        ctx, toks = 2, []
        for t in range(10):
            top = sorted(BIGRAM[ctx].items(), key=lambda x: (-x[1], x[0]))[:2]
            ctx = max(top, key=lambda x: x[1] / temperature + _noise(seed, i, s, t, x[0]))[0]
            toks.append(ctx)
            if ctx == 2:
                break
        assert r.tokens == toks


def test_sample_frequencies(spark):
    """First tokens of 20,000 samples follow exp(lp / T), within four standard errors."""
    got = dec.topk_sample(spark.createDataFrame([(0,)], "id int"), _table(spark), ["id"], n=20_000, k=3, temperature=0.5, maxlen=1, seed=3)
    seen = {r.t: r["count"] for r in got.groupBy(F.element_at("tokens", 1).alias("t")).count().collect()}
    weight = {t: math.exp(lp / 0.5) for t, lp in BIGRAM[2].items()}
    for t, w in weight.items():
        p = w / sum(weight.values())
        assert abs(seen[t] / 20_000 - p) < 4 * math.sqrt(p * (1 - p) / 20_000)

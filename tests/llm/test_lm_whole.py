"""Operator 4 does the whole job: nothing of the corpus on the driver, weights from all training documents."""

import inspect
import random
import zlib
from collections import Counter

import numpy as np
import pyspark
import pytest

from seqcorpus.llm import lm_scoring as lm


def _docs(n=300, seed=3):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(120)]
    return [(i, " ".join(vocab[int(rnd.random() ** 3 * 120)] for _ in range(rnd.randint(0, 60)))) for i in range(n)]


def _brute(docs):
    """Scores from exact counts, quantised to levels as the operator does."""
    tokens = {d: [*t.split(), "</s>"] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c, pairs = Counter(), Counter()
    for d, t in tokens.items():
        if not held[d]:
            c.update(t)
            pairs.update(zip(["</s>", *t[:-1]], t, strict=True))  # a document starts after an end
    n, v, value = sum(c.values()), len(c), lm.level_counts()
    level = lambda x: int(lm.level_of(np.array([x]))[0]) if x else 0

    def parts(a, b, less):
        both, prev = level(pairs[a, b]), level(c[a])
        return prev, min(1, max(value[both] - less, 0) / max(value[max(prev, both)] - less, 1)), (max(c[b] - less, 0) + 1) / (n + v + 1)

    table = np.zeros((lm.LEVELS, len(lm.WEIGHTS)))
    for (a, b), times in pairs.items():
        prev, pair, uni = parts(a, b, 1)
        table[prev] += times * np.log10(lm.WEIGHTS * pair + (1 - lm.WEIGHTS) * uni)
    weight = lm.WEIGHTS[np.argmax(table, axis=1)]
    out = {}
    for d, t in tokens.items():
        p = [parts(a, b, 0) for a, b in zip(["</s>", *t[:-1]], t, strict=True)]
        out[d] = sum(np.log10(weight[q] * x + (1 - weight[q]) * u) for q, x, u in p)
    return out


@pytest.mark.parametrize("slice_words", [1 << 20, 50])
def test_scores_against_brute_force(spark, slice_words):
    docs = _docs()
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), slice_words=slice_words).collect()}
    want = _brute(docs)
    off = np.array([abs(got[d] - want[d]) / max(1, abs(want[d])) for d in want])
    # false positives of the filter may lift some pairs, by a level mostly
    assert got.keys() == want.keys() and np.median(off) < 0.01 and off.mean() < 0.02


def test_nothing_of_the_corpus_on_the_driver(spark, monkeypatch):
    sent = []
    real = pyspark.SparkContext.broadcast

    def broadcast(self, value):
        sent.append(value)
        return real(self, value)

    def refuse(self, *a, **k):
        raise AssertionError("the rows of a table go to the driver one after another")

    monkeypatch.setattr(pyspark.SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", refuse)
    out = lm.score(spark.createDataFrame(_docs(60), "doc_id long, text string"), slice_words=100)
    assert out.count() == 60 and not sent


def test_filter_has_its_bits_at_every_size():
    assert "max_bits" not in inspect.signature(lm.score).parameters
    rng = np.random.default_rng(1)
    for n in (1000, 200_000):
        key = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        bits = lm.filter_segment(key, np.ones(len(key), np.int64))
        assert 8 * len(bits) >= lm.BITS * len(key)
        filt = lm.LogFrequencyFilter(bits, np.array([8 * len(bits)], np.uint64))
        assert (filt.level(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) > 0).mean() < 0.04

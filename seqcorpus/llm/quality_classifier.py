"""Quality classifier from weak labels (operator 3).

Heuristic labellers vote good (1), bad (-1) or abstain (0) on every document, from statistics of its whole
text.  The votes of all documents are counted by pattern; expectation-maximisation over these counts
estimates, for each labeller, how often it votes what on good and on bad documents, and the share of good
ones (labellers taken as independent given the class; the start trusts each).  A pattern's posterior labels the
documents that show it.  A hashed linear scorer (logistic regression on words, word beginnings and word
shapes) is trained on the posterior labels of a bounded sample, ``sample_docs`` documents by hash, and scores
every document; so it also judges what no labeller votes on.

A second head of the same scorer finds toxic documents: hashed words and beginnings that labelled toxic rows
(a bounded sample, ``labelled_rows``) have far more often than the others weigh their log odds.

Defined cases: null, empty and wordless texts vote bad (labeller "empty") and score by the bias alone; null labels
are left out; without toxic labels nothing is toxic; repeated rows are counted and scored each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcorpus.llm.common import slices, text_buffers, written
from seqcorpus.llm.quality_rules import statistics
from seqcorpus.llm.words import mix, words_of

WORD_BITS, START_BITS, SHAPE_BITS = 17, 16, 12
SIZE = (1 << WORD_BITS) + (1 << START_BITS) + (1 << SHAPE_BITS)

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 4
for _c in b"#*$%&|<>":
    _CLASS[_c] = 8
for _c in b".,;:!?'\"()-":
    _CLASS[_c] = 16
_CLASS[128:] = 32
_CLASS[_CLASS == 0] = 64


def labellers() -> dict[str, Column]:
    """Vote columns over the columns of :func:`quality_rules.statistics`.  Each kind of junk has a labeller
    that votes bad or abstains; "natural" votes good where nothing is conspicuous."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n
    letters = F.greatest("word_chars", F.lit(1))
    bad = lambda c: F.when(c, -1).otherwise(0)
    return {
        "symbols": bad(share("n_symbols") > 0.2),
        "capitals": bad(F.col("n_upper") > 0.4 * letters),
        "repeats": bad(share("n_repeat_words") > 0.2),
        "lines": bad((F.col("n_dup_lines") > 0.3 * F.greatest("n_lines", F.lit(1))) & (F.col("n_lines") >= 4)),
        "word_length": bad((F.col("n_words") >= 10) & ((share("word_chars") < 2.5) | (share("word_chars") > 12))),
        "variety": bad((share("n_distinct") < 0.3) & F.col("n_words").between(50, 2000)),
        "empty": bad(F.col("n_words") == 0),
        "natural": F.when((F.col("n_words") > 0) & (share("n_symbols") < 0.05) & (F.col("n_upper") < 0.15 * letters) & (share("n_repeat_words") < 0.1), 1).otherwise(0),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Share of good documents, vote probabilities (labeller, class, vote) and posterior of each pattern."""
    if not patterns:
        return 0.5, np.zeros((0, 2, 3)), {}
    votes = np.array(list(patterns), np.int64) + 1  # 0 bad, 1 abstains, 2 good
    times = np.array(list(patterns.values()), float)
    m = votes.shape[1]
    # the start: bad votes are rare on good documents, and a good vote is rarer on bad ones
    share, prob = 0.8, np.tile(np.array([[0.24, 0.7, 0.06], [0.005, 0.395, 0.6]]), (m, 1, 1))
    single = (votes != 2).all(axis=0)  # labellers that never vote good
    prob[single] = np.array([[0.24, 0.76, 1e-9], [0.005, 0.995, 1e-9]])
    at = np.arange(m)
    for _ in range(rounds):
        log = np.stack([np.log(prob[at, k][at, votes]).sum(axis=1) + math.log(p) for k, p in ((0, 1 - share), (1, share))])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        share = float(np.clip((good * times).sum() / times.sum(), 0.01, 0.99))
        for j in range(m):
            for k, w in ((0, (1 - good) * times), (1, good * times)):
                c = np.bincount(votes[:, j], w, minlength=3) + np.array([[0.24, 0.7, 0.06], [0.005, 0.395, 0.6]])[k]
                prob[j, k] = c / c.sum()
    return share, prob, dict(zip(patterns, good.tolist(), strict=True))


def features(data: np.ndarray, off: np.ndarray, lo: int, hi: int):
    """(row, feature) of each word's three features, and words of each row (at least 1)."""
    w = words_of(data, off, lo, hi)
    n = np.maximum(np.diff(w.first), 1)
    row = w.row
    if not len(row):
        return row, np.zeros(0, np.int64), n
    padded = np.append(data, np.zeros(4, np.uint8))
    base = off[lo]
    kinds = np.append(_CLASS[data[base:off[hi]]], np.uint8(0))
    edges = np.stack([w.start, w.end], axis=1).ravel() - base
    has = np.bitwise_or.reduceat(kinds, edges)[::2].astype(np.int64)
    begin = np.zeros(len(row), np.uint64)
    for k in range(4):
        b = padded[w.start + k]
        b = np.where((b >= 65) & (b < 91), b + 32, b).astype(np.uint64)
        begin = begin * np.uint64(256) + np.where(w.start + k < w.end, b, np.uint64(0))
    again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1]))
    shape = (has << 5 | np.minimum(w.end - w.start, 15) << 1 | again) % (1 << SHAPE_BITS)
    word = (w.hash & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    start = (mix(begin) & np.uint64((1 << START_BITS) - 1)).astype(np.int64)
    feature = np.concatenate([word, start + (1 << WORD_BITS), shape + (1 << WORD_BITS) + (1 << START_BITS)])
    return np.tile(row, 3), feature, n


def distinct_features(row, feature):
    """Distinct (row, feature) and the times of each."""
    key, times = np.unique(row.astype(np.int64) << 20 | feature, return_counts=True)
    return key >> 20, key & ((1 << 20) - 1), times


def feature_rows(docs: DataFrame, y: str, shares: bool = True, text: str = "text") -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Label, features and, with ``shares``, their shares of the words, of a bounded sample, on the driver."""
    def task(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in slices(off):
                row, feature, n = features(data, off, lo, hi)
                row, feature, times = distinct_features(row - lo, feature)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                value = (times / n[row]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.float64()),
                    pa.array([feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    pa.array([value[a:b].tobytes() if shares else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["y", "f", "x"])

    got = docs.select(F.col(y).cast("double").alias("y"), text).mapInArrow(task, "y double, f binary, x binary").collect()
    return [(r.y, np.frombuffer(r.f, np.int32), np.frombuffer(r.x, np.float32)) for r in sorted(got, key=lambda r: (r.f, r.x, r.y))]


def train(rows, epochs: int = 12, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad on soft labels."""
    weight, square, bias, bias_square = np.zeros(SIZE), np.full(SIZE, 1e-2), 0.0, 1e-2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, f, x = rows[i]
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weight[f] @ x) + bias)))) - y
            gx = g * x + 1e-5 * weight[f]
            square[f] += gx * gx
            weight[f] -= rate * gx / np.sqrt(square[f])
            bias_square += g * g
            bias -= rate * g / math.sqrt(bias_square)
    return weight, bias


def toxic_weights(rows, least: int = 4, part: float = 0.02, odds: float = 60.0) -> np.ndarray:
    """Log odds of the features that toxic rows have at least ``odds`` times as often as others,
    and at least ``part`` of them have."""
    seen = np.zeros((2, SIZE))
    n = [0, 0]
    for y, f, _ in rows:
        seen[int(y > 0.5), f] += 1
        n[int(y > 0.5)] += 1
    if not n[0] or not n[1]:
        return np.zeros(SIZE)
    seen[:, (1 << WORD_BITS) + (1 << START_BITS):] = 0  # shapes tell nothing here
    ratio = (seen[1] / n[1]) / ((seen[0] + 0.5) / n[0])
    return np.where((seen[1] >= max(least, part * n[1])) & (ratio >= odds), np.log(np.maximum(ratio, 1.0)), 0.0)


def toxic_threshold(rows, weight: np.ndarray, precision: float = 0.98) -> float:
    """The lowest score from which on the labelled rows are toxic with this precision."""
    scores = sorted(((float(weight[f].sum()), y > 0.5) for y, f, _ in rows), reverse=True)
    best, hits = math.inf, 0
    for k, (x, y) in enumerate(scores, 1):
        hits += y
        if x <= 0:
            break
        if hits >= precision * k and (k == len(scores) or scores[k][0] < x):
            best = x
    return best


def classify(docs: DataFrame, labels: DataFrame | None = None, sample_docs: int = 4000, labelled_rows: int = 10_000,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, posterior, quality_score, toxic_score, toxic, kept) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    votes = labellers()
    pattern = F.concat_ws(",", *[v.cast("string") for v in votes.values()])
    voted = written(statistics(docs).select("doc_id", "n_words", F.xxhash64("doc_id", "text").alias("h"), pattern.alias("pattern")), "votes")
    counted = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** labellers rows
    _, _, posterior = estimate({tuple(map(int, r.pattern.split(","))): r.n for r in sorted(counted, key=lambda r: r.pattern)})
    table = spark.createDataFrame([(",".join(map(str, k)), v) for k, v in posterior.items()] or [("", 0.5)], "pattern string, posterior double")
    voted = voted.join(F.broadcast(table), "pattern")
    total = sum(r.n for r in counted)
    chosen = voted.where(F.pmod("h", F.lit(max(1, total // sample_docs))) == 0).orderBy("h").limit(2 * sample_docs).select("h", "posterior").dropDuplicates(["h"])
    keyed = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    sample = feature_rows(keyed.join(F.broadcast(chosen), "h"), "posterior")
    weight, bias = train(sample)
    toxic, toxic_from = np.zeros(SIZE), math.inf
    if labels is not None:
        known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)
        rows = feature_rows(docs.join(F.broadcast(known), "doc_id"), "toxic", shares=False)
        toxic = toxic_weights(rows).astype(np.float32)
        toxic_from = toxic_threshold(rows, toxic) - 1e-4
    shared = spark.sparkContext.broadcast((weight.astype(np.float32), bias, toxic.astype(np.float32)))  # fixed size

    def task(batches):
        weight, bias, toxic = shared.value
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            good, bad = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi in slices(off):
                row, feature, n = features(data, off, lo, hi)
                linear = np.bincount(row - lo, weight[feature], minlength=hi - lo)
                good[lo:hi] = 1 / (1 + np.exp(-np.clip(linear / n + bias, -30, 30)))
                hit = np.flatnonzero(toxic[feature])
                r, f, _ = distinct_features(row[hit] - lo, feature[hit])
                bad[lo:hi] = np.bincount(r, toxic[f], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(good), pa.array(bad)], names=["h", "quality_score", "toxic_score"])

    scored = keyed.select("doc_id", "text", "h").mapInArrow(task, "h long, quality_score double, toxic_score double").dropDuplicates(["h"])
    out = voted.join(scored, "h").withColumn("toxic", F.col("toxic_score") >= F.lit(toxic_from))
    return out.select("doc_id", "n_words", "posterior", "quality_score", "toxic_score", "toxic",
                      ((F.col("quality_score") >= 0.5) & ~F.col("toxic")).alias("kept"))

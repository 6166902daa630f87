"""Hard negatives by integer inner products (operator 12).

Scores of a tile of anchors against a tile of candidates are one matrix product of int64 numbers, by Strassen's
recursion: the three sides are padded with zeros to a multiple of 2^levels, seven half-size products replace eight,
and all sums are integer sums (int64 sums wrap around and wrap back, so no sum on the way can spoil the result).
At the leaves a product runs in doubles where every partial sum is proven below 2^53, and in int64 otherwise.

Anchors go out in groups of at most ``GROUP_BYTES``, by broadcast; each group takes two passes over all candidates.
The first keeps a heap of the best positives of each anchor, the second a heap for each (anchor, positive) of the best
rows of other labels whose score lies in the window that the positive's score opens.  Heaps of tiles merge
within a task, those of tasks in a final ranking; nothing but heaps leaves a task.

Defined cases: rows with a null id, a null label, or a null or empty vector, one with null or non-finite
components, or one of another length than most rows have (of equally frequent lengths, the smallest) take no
part; a repeated row is a candidate each time and an anchor each time, but rows of an anchor's own id are never its
candidates; equal scores go by the smaller id; fewer rows than asked for give all of them; an empty table gives an
empty result; extra columns are ignored.  Scores that 64 bits can't hold 100 times over stop the query.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqcorpus.llm.common import shared_folder, written

GROUP_BYTES = 1 << 25
ANCHOR_TILE = 1024
TILE = 2048
LEAF = 32
LEAST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bound = a.shape[1] * _greatest(a) * _greatest(b)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _greatest(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r, c = a.shape[0] // 2, a.shape[1] // 2
    return a[:r, :c], a[:r, c:], a[r:, :c], a[r:, c:]


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if levels == 0:
        return _leaf(a, b)
    (a11, a12, a21, a22), (b11, b12, b21, b22) = _halves(a), _halves(b)
    m1 = _product(a11 + a22, b11 + b22, levels - 1)
    m2 = _product(a21 + a22, b11, levels - 1)
    m3 = _product(a11, b12 - b22, levels - 1)
    m4 = _product(a22, b21 - b11, levels - 1)
    m5 = _product(a11 + a12, b22, levels - 1)
    m6 = _product(a21 - a11, b11 + b12, levels - 1)
    m7 = _product(a12 - a22, b21 + b22, levels - 1)
    return np.block([[m1 + m4 - m5 + m7, m3 + m5], [m2 + m4, m1 - m2 + m3 + m6]])


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, exactly (modulo 2^64)."""
    (m, k), n = a.shape, b.shape[1]
    if not m or not n:
        return np.zeros((m, n), np.int64)
    levels = max(0, int(math.log2(max(1, min(m, k, n) / leaf))))
    step = 1 << levels
    up = lambda s: -(-s // step) * step
    left, right = np.zeros((up(m), up(k)), np.int64), np.zeros((up(k), up(n)), np.int64)
    left[:m, :k], right[:k, :n] = a, b
    return _product(left, right, levels)[:m, :n]


class Heaps:
    """For each of ``n`` keys the best ``k`` of what was offered: highest score first, then smallest id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LEAST)
        self.ids = np.full((n, k), LAST)
        self.size = np.zeros(n, np.int64)

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        """The masked scores of a tile; its row r is key first + r, its column c the row ids[c]."""
        rows = slice(first, first + len(scores))
        mask = mask & ((scores >= self.score[rows, -1:]) | (self.size[rows, None] < self.k))
        many = np.flatnonzero(mask.sum(axis=1) > self.k)
        if len(many):
            seen = np.where(mask[many], scores[many], LEAST)
            mask[many] &= seen >= np.partition(seen, -self.k, axis=1)[:, -self.k, None]
        r, c = np.nonzero(mask)
        self.merge(r + first, scores[r, c], ids[c])

    def merge(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Entries (key, score, id) join the heaps of their keys."""
        if not len(key):
            return
        touched = np.unique(key)
        held = np.arange(self.k)[None, :] < self.size[touched, None]
        at, slot = np.nonzero(held)
        key = np.concatenate([touched[at], key])
        score = np.concatenate([self.score[touched[at], slot], score])
        ids = np.concatenate([self.ids[touched[at], slot], ids])
        order = np.lexsort((ids, ~score, key))  # ~score falls as score rises, without overflow
        key, score, ids = key[order], score[order], ids[order]
        place = np.arange(len(key)) - np.searchsorted(key, key)
        best = place < self.k
        self.score[touched], self.ids[touched] = LEAST, LAST
        self.score[key[best], place[best]], self.ids[key[best], place[best]] = score[best], ids[best]
        self.size[touched] = np.bincount(np.searchsorted(touched, key[best]), minlength=len(touched))

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, slot = np.nonzero(np.arange(self.k)[None, :] < self.size[:, None])
        return key, self.score[key, slot], self.ids[key, slot]


def prepared(rows: DataFrame, scale: float, label: Column, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v in whole numbers."""
    x = F.col(embedding).cast("array<double>")
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x")).where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0").where(
        F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return out.select("vec_id", "label", F.transform("x", lambda c: F.floor(F.lit(scale) * c)).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
         label: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which
    ``is_anchor`` (a column expression of vec_id) holds and each of its best ``positives`` rows of the same label, the best ``negatives``
    rows of other labels with low * positive_score <= 100 * score <= high * positive_score."""
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kept = prepared(rows, scale, F.col("label") if label is None else label, vec_id, embedding)
    kept = written(kept, "mining-rows")
    size = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("top"))
    size = size.orderBy(F.desc("n"), "d").limit(1).collect()
    if not size:
        return spark.createDataFrame([], schema)
    dim, top = size[0].d, size[0].top
    if 100 * dim * top * top >= 1 << 63:
        raise ValueError(f"inner products of {dim} numbers up to {top} don't fit 64 bits")
    kept = kept.where(F.size("v") == dim)

    # groups of at most ``per`` anchors, numbered by (bucket, part); repeated rows share a bucket and are split
    anchors = kept.where(is_anchor(F.col("vec_id")))
    per = max(1, group_bytes // (8 * dim))
    buckets = max(1, -(-anchors.count() // per))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("vec_id", "label"))
    anchors = anchors.withColumn("bucket", F.pmod(F.xxhash64("vec_id", "v"), F.lit(buckets))).withColumn("n", place - 1)
    anchors = written(anchors.select("bucket", F.floor(F.col("n") / per).alias("part"), (F.col("n") % per).cast("int").alias("a"), "vec_id", "label", "v"), "mining-anchors")
    groups = [(r.bucket, r.part) for r in anchors.groupBy("bucket", "part").count().orderBy("bucket", "part").toLocalIterator()]
    out = f"{shared_folder(spark)}/hard-negatives-{uuid.uuid4().hex}"
    for bucket, part in groups:
        group = anchors.where((F.col("bucket") == bucket) & (F.col("part") == part)).orderBy("a")
        _mine_group(kept, group.select("vec_id", "label", "v").toArrow(), dim, positives, negatives, low, high).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if groups else spark.createDataFrame([], schema)


def _mine_group(kept: DataFrame, group: pa.Table, dim: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result rows of one group of anchors, which the driver holds (at most ``group_bytes``)."""
    spark = kept.sparkSession
    group = group.combine_chunks()
    own, own_label, matrix = group.column(0).to_numpy(), group.column(1).to_numpy(), _matrix(group.column(2).combine_chunks(), dim)
    shared = spark.sparkContext.broadcast((own, own_label, matrix))

    def tiles(batches):
        """(first anchor, ids of the candidates, scores, whether a candidate may be one, whether it has the label)"""
        own, own_label, matrix = shared.value
        for batch in batches:
            ids, label, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dim)
            for lo in range(0, len(ids), TILE):
                cut = slice(lo, lo + TILE)
                across = np.ascontiguousarray(x[cut].T)
                for a in range(0, len(own), ANCHOR_TILE):
                    mine = slice(a, a + ANCHOR_TILE)
                    other = own[mine, None] != ids[None, cut]
                    yield a, ids[cut], strassen(matrix[mine], across), other, own_label[mine, None] == label[None, cut]

    def best_positives(batches):
        heaps = Heaps(len(shared.value[0]), positives)
        for a, ids, scores, other, same in tiles(batches):
            heaps.offer(a, scores, ids, other & same)
        key, score, ids = heaps.entries()
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(ids), pa.array(score)], names=["a", "id", "score"])

    found = kept.mapInArrow(best_positives, "a int, id long, score long")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("j", F.row_number().over(order) - 1).where(F.col("j") < positives).toArrow()  # anchors x positives rows
    at = ranked.column("a").to_numpy(), ranked.column("j").to_numpy()
    p_id, p_score = np.zeros((2, len(own), positives), np.int64)
    p_there = np.zeros((len(own), positives), bool)
    p_id[at], p_score[at], p_there[at] = ranked.column("id").to_numpy(), ranked.column("score").to_numpy(), True
    windows = spark.sparkContext.broadcast((p_id, p_score, p_there))

    def best_negatives(batches):
        own = shared.value[0]
        p_id, p_score, p_there = windows.value
        heaps = [Heaps(len(own), negatives) for _ in range(positives)]
        for a, ids, scores, other, same in tiles(batches):
            mine, free, hundred = slice(a, a + len(scores)), other & ~same, 100 * scores
            for j, heap in enumerate(heaps):
                p = p_score[mine, j, None]
                heap.offer(a, scores, ids, free & p_there[mine, j, None] & (low * p <= hundred) & (hundred <= high * p))
        for j, heap in enumerate(heaps):
            key, score, ids = heap.entries()
            cols = [key.astype(np.int32), np.full(len(key), j, np.int32), own[key], p_id[key, j], ids, p_score[key, j], score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    names = ["a", "j", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    pairs = kept.mapInArrow(best_negatives, "a int, j int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("a", "j").orderBy(F.desc("negative_score"), "negative_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

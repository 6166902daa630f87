"""Approximate nearest neighbours by adaptive dimension scan over inverted lists (operator 7).

Index: centroids by k-means on a bounded sample of vectors (``fit_rows``, by hash of the id); every vector is
assigned to its nearest centroid.  Vectors get one more dimension, sqrt(M^2 - |x|^2) with M the greatest
norm, and queries a zero, so that the order by distance is the order by inner product, and are rotated by a
fixed random orthogonal matrix.  Lists are cut into blocks of at most ``BLOCK`` rows.

Search: each query probes its ``probes`` nearest lists.  A task holds one block by column blocks of
``COLUMNS`` rotated dimensions, and the queries that probe its list; after each column block, candidates whose
partial distance, scaled up, exceeds the query's bound by more than a factor 1 + ``epsilon`` / sqrt(d seen) are
given up (the hypothesis that they are within the bound is rejected).  The bound is the query's 2k-th
smallest distance to those rows of the fitted sample that lie in its lists, and are candidates there.  What
is left is scored exactly, in double precision on the original vectors; the best k of each block meet in a
final ranking.  A query that is left with fewer than k gets a second search, of all lists and without bound.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, as query or candidate; a null vec_id takes no part; repeated vec_ids are candidates
each, and ask once, with the smallest vector; a query is no candidate of its own id; equal scores go by the smaller vec_id; fewer candidates than k
give all of them; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqcorpus.llm.common import written

BLOCK = 2048
QUERIES = 512
COLUMNS = 16


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, as doubles."""
    v = F.col(embedding).cast("array<double>")
    out = rows.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return out.where(F.size("v") > 0).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(
        F.exists("v", lambda x: x != 0))


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Plain k-means; an empty list takes a random row."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest_lists(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], distinct[rng.choice(len(distinct), len(centres))])
    return centres


def nearest_lists(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    d = (centres**2).sum(axis=1) - 2 * x @ centres.T
    if count == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :count]


def exact_scores(cand: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, one product after another: equal vectors have equal scores in any batch."""
    return np.einsum("ij,ij->i", cand, query)


def scan(cand_rot: np.ndarray, query_rot: np.ndarray, bound: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) places that are left after the adaptive dimension scan of a block, column block by
    column block.  ``bound`` holds each query's squared distance to beat."""
    dim = cand_rot.shape[1]
    q = c = partial = None
    for lo in range(0, dim, COLUMNS):
        hi = min(dim, lo + COLUMNS)
        x, y = cand_rot[:, lo:hi], query_rot[:, lo:hi]
        if q is None:  # the first columns: all pairs of the block at once
            part = (y**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * y @ x.T
        else:
            part = partial + ((x[c] - y[q]) ** 2).sum(axis=1)
        # the hypothesis "within the bound" is rejected when the scaled partial distance is too large
        slack = (1 + epsilon / math.sqrt(hi)) ** 2 * hi / dim if hi < dim else 1.0
        limit = bound * slack + 1e-9 * (1 + bound)
        if q is None:
            q, c = np.nonzero(part <= limit[:, None])
            partial = part[q, c]
        else:
            keep = part <= limit[q]
            q, c, partial = q[keep], c[keep], part[keep]
        if not len(q):
            break
    return q, c


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each query: by score, then by the smaller id."""
    order = np.lexsort((ids, -score, q))
    first = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def enough_probes(sample: np.ndarray, up: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many lists hold ``recall`` of the true nearest neighbours of some sample rows within the sample."""
    ask = np.arange(0, len(sample), max(1, len(sample) // 300))
    near = sample[ask] @ sample.T
    near[np.arange(len(ask)), ask] = -np.inf
    top = np.argsort(-near, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    home = nearest_lists(up, centres, 1)[:, 0]
    order = nearest_lists(np.hstack([sample[ask], np.zeros((len(ask), 1))]), centres, len(centres))
    place = np.argsort(order, axis=1)
    ranks = np.sort(np.take_along_axis(place, home[top], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1 if len(ranks) else 1


def search(rows: DataFrame, is_query, k: int = 20, lists: int | None = None, probes: int | None = None, fit_rows: int = 20_000,
           recall: float = 0.98, epsilon: float = 2.1, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row for which ``is_query`` (a column
    expression of vec_id) holds.  ``lists`` defaults to the root of the row count, ``probes`` to what reaches ``recall`` on the sample."""
    spark = rows.sparkSession
    vectors = usable(rows, vec_id, embedding)
    dims = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, total = dims[0].d, dims[0].n
    vectors = written(vectors.where(F.size("v") == dim).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "vectors")
    longest = math.sqrt(vectors.agg(F.max("norm")).first()[0])
    lists = lists or max(1, round(math.sqrt(total)))
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // fit_rows))) == 0)
    sample = sample.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * fit_rows).toArrow()
    sample_ids, sample = sample.column(0).to_numpy(), matrix(sample.column(1), dim)
    lift = lambda x: np.hstack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))[:, None]])
    centres = fit_centroids(lift(sample), lists)
    probes = min(len(centres), probes or enough_probes(sample, lift(sample), centres, k, recall))
    turn = rotation(dim + 1)
    shared = spark.sparkContext.broadcast((centres, turn, longest))  # lists x (dim + 1) numbers
    homes = nearest_lists(lift(sample), centres, 1)[:, 0]
    fitted = spark.sparkContext.broadcast((sample_ids, sample, homes))  # 2 * fit_rows vectors at most

    def assign(batches):
        centres, turn, longest = shared.value
        for batch in batches:
            x = matrix(batch.column(1), dim)
            up = np.hstack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))[:, None]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()),
                                              pa.array(nearest_lists(up, centres, 1)[:, 0].astype(np.int32))], names=["vec_id", "x", "list"])

    def probe(batches):
        centres, turn, longest = shared.value
        sample_ids, sample, homes = fitted.value
        far = (sample**2).sum(axis=1) + np.maximum(longest**2 - (sample**2).sum(axis=1), 0)  # of the lifted vectors
        for batch in batches:
            x, own = matrix(batch.column(1), dim), batch.column(0).to_numpy()
            near = nearest_lists(np.hstack([x, np.zeros((len(x), 1))]), centres, probes).astype(np.int32)
            bound = np.full(len(x), np.inf)
            for lo in range(0, len(x) if len(sample) > 2 * k else 0, 256):
                y = x[lo:lo + 256]
                d = far[None, :] + (y**2).sum(axis=1)[:, None] - 2 * y @ sample.T
                probed = np.zeros((len(y), len(centres)), bool)
                np.put_along_axis(probed, near[lo:lo + 256], True, axis=1)
                d[(own[lo:lo + 256][:, None] == sample_ids[None, :]) | ~probed[:, homes]] = np.inf
                bound[lo:lo + 256] = np.partition(d, 2 * k - 1, axis=1)[:, 2 * k - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(np.maximum(bound, 0)),
                                              pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * probes, pa.array(near.ravel()))],
                                             names=["vec_id", "x", "bound", "lists"])

    listed = written(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, x binary, list int"), "lists")
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    asked = vectors.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(probe, "vec_id long, x binary, bound double, lists array<int>")
    asked = written(asked, "probes")
    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        _, turn, longest = shared.value
        raw = lambda t: np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(-1, dim)
        cand, query, bound = raw(left), raw(right), right.column("bound").to_numpy()
        ids, own = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        c_rot = np.hstack([cand, np.sqrt(np.maximum(longest**2 - (cand**2).sum(axis=1), 0))[:, None]]) @ turn
        q_rot = np.hstack([query, np.zeros((len(query), 1))]) @ turn
        q, c = scan(c_rot, q_rot, bound, epsilon)
        other = ids[c] != own[q]
        q, c = q[other], c[other]
        score = exact_scores(cand[c], query[q])
        best = best_of(q, ids[c], score, k)
        return pa.table({"query_id": own[q[best]], "vec_id": ids[c[best]], "score": score[best]})

    def found(asked):
        # a unit is a block of a list and a part of the queries that probe it
        by_list = asked.select("vec_id", "x", "bound", F.explode("lists").alias("list"))
        groups = by_list.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        plan = written(sizes.join(groups, "list"), "list-plan")  # a row a list
        asks = by_list.join(F.broadcast(plan), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
        asks = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "part", "vec_id", "x", "bound")
        cands = listed.join(F.broadcast(plan), "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        cands = cands.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "block", "part", "vec_id", "x")
        units = ("list", "block", "part")
        got = cands.groupBy(*units).cogroup(asks.groupBy(*units)).applyInArrow(meet, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = written(found(asked), "nearest")
    full = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return first
    everywhere = short.withColumns({"bound": F.lit(float("inf")), "lists": F.array(*[F.lit(i) for i in range(len(centres))])})
    return first.join(full.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", "rank", "vec_id", "score").unionAll(
        found(written(everywhere, "short-probes")))

import time
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqcorpus.operators import lexical_em as em
from seqcorpus.operators.align import symmetrize

PAIRS = [([4, 5], [10, 11]), ([4], [10]), ([5, 6, 5], [11, 12]), ([], [10]), ([6], []), (None, [12]), ([7, 4, 6], [12, 10, 13, 10])]


def plain_em(pairs, rounds):
    t, out = None, []
    for _ in range(rounds):
        count, ll = defaultdict(float), 0.0
        for s, f in pairs:
            s = [*(s or []), em.NULL_WORD]
            for w in f or []:
                z = sum(t[e, w] if t else 1.0 for e in s)
                if t:
                    from math import log
                    ll += log(z / len(s))
                for e in s:
                    count[e, w] += (t[e, w] if t else 1.0) / z
        total = defaultdict(float)
        for (e, _), c in count.items():
            total[e] += c
        t = {k: c / total[k[0]] for k, c in count.items()}
        out.append(ll)
    return t, out[1:]


@pytest.mark.parametrize("range_pairs", [em.RANGE_PAIRS, 3])
def test_em_against_plain_version(spark, range_pairs):
    df = spark.createDataFrame(PAIRS, "s array<int>, f array<int>").repartition(3)
    model, ll = em.lexical_em(df, "s", "f", 4, range_pairs)
    want, want_ll = plain_em(PAIRS, 4)
    got = {(r.src_id, r.tgt_id): r.prob for r in model.collect()}
    assert got == pytest.approx(want, abs=1e-12) and ll == pytest.approx(want_ll)
    assert ll == sorted(ll), "the likelihood never falls"


def test_best_links(spark):
    rows = [(i, s, f) for i, (s, f) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "id int, s array<int>, f array<int>")
    model, _ = em.lexical_em(df, "s", "f", 4)
    t = {(r.src_id, r.tgt_id): r.prob for r in model.collect()}
    for limit in (em.RANGE_PAIRS, 3):
        got = {r.id: [(x.src_pos, x.tgt_pos) for x in r.links] for r in em.best_links(df, ["id"], "s", "f", model, limit).collect()}
        for i, s, f in rows:
            want = []
            for j, w in enumerate(f or []):
                options = [*(s or []), em.NULL_WORD]
                best = max(range(len(options)), key=lambda k: (t[options[k], w], -k))
                if best < len(options) - 1:
                    want.append((best, j))
            assert got[i] == sorted(want)


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "id int, s array<int>, f array<int>")
    model, ll = em.lexical_em(df, "s", "f", 3)
    assert model.collect() == [] and ll == []
    assert em.best_links(df, ["id"], "s", "f", model).collect() == []


def plain_grow_diag_final_and(forward, backward):
    """The published heuristic on sets of points."""
    union, have = set(forward) | set(backward), set(forward) & set(backward)
    free = lambda k, w: all(p[k] != w for p in have)
    while True:
        before = len(have)
        rows, cols = max((p[0] for p in union), default=-1), max((p[1] for p in union), default=-1)
        for i in range(rows + 1):
            for j in range(cols + 1):
                if (i, j) in have:
                    for di, dj in em.NEIGHBOURS:
                        p = (i + di, j + dj)
                        if p in union and p not in have and (free(0, p[0]) or free(1, p[1])):
                            have.add(p)
        if len(have) == before:
            break
    for side in (forward, backward):
        for p in sorted(side):
            if free(0, p[0]) and free(1, p[1]):
                have.add(p)
    return sorted(have)


def test_symmetrisation_on_random_links(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        n, m = rng.randint(1, 9), rng.randint(1, 9)
        links = lambda: list({(rng.randrange(n), rng.randrange(m)) for _ in range(rng.randint(0, 14))})  # noqa: B023, E731
        rows.append((i, links(), links()))
    rows += [(1000, [], []), (1001, [(0, 0)], []), (1002, [(3, 2), (3, 2)], [(3, 2)])]
    kind = "array<struct<src_pos: int, tgt_pos: int>>"
    df = spark.createDataFrame(rows, f"id int, a {kind}, b {kind}")
    got = df.select("id", em.grow_diag_final_and("a", "b").alias("g"), symmetrize("a", "b").alias("i"), symmetrize("a", "b", "union").alias("u")).collect()
    points = lambda x: [(p.src_pos, p.tgt_pos) for p in x]
    for r, (_, a, b) in zip(sorted(got, key=lambda r: r.id), sorted(rows), strict=True):
        assert points(r.g) == plain_grow_diag_final_and(a, b)
        assert points(r.i) == sorted(set(a) & set(b)) and points(r.u) == sorted(set(a) | set(b))


def test_symmetrisation_of_long_pairs(spark):
    """A pair of 2000 links a side is some milliseconds' work; walking the union for each neighbour took minutes."""
    a = [(i, i) for i in range(2000)]
    b = [(min(i + i % 2, 1999), i) for i in range(2000)]
    df = spark.createDataFrame([(a, b), (None, b)], "a array<struct<src_pos: int, tgt_pos: int>>, b array<struct<src_pos: int, tgt_pos: int>>")
    start = time.time()
    got = [r[0] for r in df.select(em.grow_diag_final_and("a", "b")).collect()]
    assert time.time() - start < 30
    assert got[1] is None and {(x.src_pos, x.tgt_pos) for x in got[0]} >= set(a) & set(b)


@pytest.mark.parametrize("limit", [1, 4, 7, 1000])
def test_blocks_hold_every_cell_once(limit):
    kind = pa.list_(pa.int32())
    src, tgt = pa.array([[4, 5, -1], [-1], [6, -1], [7, 8, 9, -1]], kind), pa.array([[10, 11], [], [10, 12, 10], [13, 10, 11]], kind)
    want = [(r, j, t, s) for r, (ss, ts) in enumerate(zip(src.to_pylist(), tgt.to_pylist(), strict=True)) for j, t in enumerate(ts) if t < 13 for s in ss]
    got = []
    for rows, places, t, n, s in em._blocks(src[0:], tgt[0:], limit, 10, 12):
        assert n.sum() == len(s) and (len(n) == 1 or n.sum() <= 2 * limit)
        got += [(*x, y) for x, y in zip((x for x, k in zip(zip(rows.tolist(), places.tolist(), t.tolist(), strict=True), n, strict=True) for _ in range(k)), s.tolist(), strict=True)]
    assert got == want
    assert [len(x[4]) for x in em._blocks(src.slice(2), tgt.slice(2), 1000)] == [2 * 3 + 4 * 3]


def test_model_lies_in_the_order_of_target_words(spark):
    rows = [([4 + i % 50, 5 + i % 31], [10 + i % 97, 11 + i % 89]) for i in range(500)]
    model, _ = em.lexical_em(spark.createDataFrame(rows, "s array<int>, f array<int>"), "s", "f", 2, 100)
    files = [(r.a, r.b) for r in model.groupBy(F.input_file_name()).agg(F.min("tgt_id").alias("a"), F.max("tgt_id").alias("b")).orderBy("a").collect()]
    assert len(files) > 1 and all(x[1] < y[0] for x, y in zip(files, files[1:]))

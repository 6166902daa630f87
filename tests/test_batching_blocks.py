"""BAT-01, BAT-05 and WIN-07 against plain versions of their rules; padding/positions golden matrices."""

import bisect
import itertools
import random

from pyspark.sql import functions as F

from seqcorpus.functions import arrays as A
from seqcorpus.operators import batching as bt
from seqcorpus.operators import blocks as blk


def _whole_sentence_blocks(sizes, B):
    """Block numbers by the rule: a block reaches to the last sentence whose end is within B of its start."""
    ends, labels, block = list(itertools.accumulate(sizes)), [], 0
    while len(labels) < len(sizes):
        begin = ends[len(labels) - 1] if labels else 0
        stop = max(bisect.bisect_right(ends, begin + B), len(labels) + 1)
        labels += [block] * (stop - len(labels))
        block += 1
    return labels


def _batches_by_rule(costs, T, S, mult):
    """Batches as ranges of ranks: before a row would break a limit, the largest multiple of ``mult`` of the
    open rows leaves (fewer than that: all of them)."""
    first, out = 0, []
    for rank in range(len(costs)):
        held = rank - first
        full = S is not None and held == S or T is not None and (held + 1) * max(costs[first:rank + 1]) > T
        if held and full:
            leave = held - held % mult if held >= mult else held
            leave = max(leave, held % mult)
            out.append(list(range(first, first + leave)))
            first += leave
    return out + ([list(range(first, len(costs)))] if first < len(costs) else [])


def test_plan_segments_random():
    rnd = random.Random(7)
    for _ in range(500):
        n = rnd.randint(0, 200)
        pairs = sorted((rnd.randint(1, 60), rnd.randint(1, 60), i) for i in range(n))
        runs = [(max(k), len(list(g))) for k, g in itertools.groupby(pairs, key=lambda x: (x[0], x[1]))]
        costs = [max(s, t) for s, t, _ in pairs]
        T, S, m = rnd.choice([100, 400, None]), rnd.choice([None, 4, 16]), rnd.choice([1, 2, 8])
        if T is None and S is None:
            S = 5
        segs = bt.plan_segments(runs, T, S, m)
        flat = [list(range(a + j * k, a + (j + 1) * k)) for a, k, e in segs for j in range(e)]
        assert flat == _batches_by_rule(costs, T, S, m)


def test_token_budget_batches_spark(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 40), rnd.randint(1, 40)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, src_len int, tgt_len int")
    got = {r.id: r.batch_id for r in bt.token_budget_batches(df, ["id"], 200, None, 8).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    want = _batches_by_rule([max(r[1], r[2]) for r in order], 200, None, 8)
    for b, ranks in enumerate(want):
        for k in ranks:
            assert got[order[k][0]] == b


def test_complete_blocks_multi_chunk(spark):
    rnd = random.Random(5)
    rows = [(st, i, rnd.choice([1, 1, 2, 5, 9, 30])) for st in ("a", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "s string, i long, size long")
    B = 12
    out = blk.blocks_complete(df, "s", ["i"], B, chunk_sentences=13).collect()
    for st in ("a", "b"):
        sizes = [r[2] for r in rows if r[0] == st]
        got = [r.block_id for r in sorted((r for r in out if r.s == st), key=lambda r: r.i)]
        assert got == _whole_sentence_blocks(sizes, B)


def test_padding_and_positions_golden(spark):
    # fixed values: the matrices must come out exactly so
    left = [[2, 3, 4, 5, 6], [1, 7, 8, 9, 10], [1, 1, 1, 11, 12]]
    right = [[2, 3, 4, 5, 6], [7, 8, 9, 10, 1], [11, 12, 1, 1, 1]]
    df = spark.createDataFrame([(i, l, r) for i, (l, r) in enumerate(zip(left, right))], "row int, l array<int>, r array<int>")
    got = df.select("row", A.convert_padding_direction("l", left_to_right=True).alias("lr"),
                    A.convert_padding_direction("r", left_to_right=False).alias("rl")).orderBy("row").collect()
    assert [list(x.lr) for x in got] == right and [list(x.rl) for x in got] == left
    pl = [[9, 9, 9, 9, 9], [1, 9, 9, 9, 9], [1, 1, 1, 9, 9]]
    pr = [[9, 9, 9, 9, 9], [9, 9, 9, 9, 1], [9, 9, 1, 1, 1]]
    d2 = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(pl, pr))], "row int, a array<int>, b array<int>")
    g2 = d2.select("row", A.make_positions("a", True).alias("x"), A.make_positions("b", False).alias("y")).orderBy("row").collect()
    assert [list(x.x) for x in g2] == [[2, 3, 4, 5, 6], [1, 2, 3, 4, 5], [1, 1, 1, 2, 3]]
    assert [list(x.y) for x in g2] == [[2, 3, 4, 5, 6], [2, 3, 4, 5, 1], [2, 3, 1, 1, 1]]


def test_shift_and_pad(spark):
    df = spark.createDataFrame([([5, 6, 2],)], "ids array<int>")
    r = df.select(A.shift_eos_first("ids").alias("p"), A.pad_to("ids", 5, True).alias("l")).first()
    assert list(r.p) == [2, 5, 6] and list(r.l) == [1, 1, 5, 6, 2]
    assert df.select(A.strip_pad(F.array(F.lit(1), F.lit(4), F.lit(1))).alias("x")).first().x == [4]


def test_complete_blocks_last_block_spans_the_look_ahead(spark):
    """The last chunk's rest fits the open block: it must not become a block of its own."""
    for n in (14, 25, 26, 27, 28, 39, 40):
        df = spark.createDataFrame([("a", i, 1) for i in range(n)], "s string, i long, size long")
        out = blk.blocks_complete(df, "s", ["i"], 12, chunk_sentences=13).collect()
        assert [r.block_id for r in sorted(out, key=lambda r: r.i)] == _whole_sentence_blocks([1] * n, 12)


def test_buffered_batches(spark):
    rnd = random.Random(8)
    sizes = [rnd.randint(1, 30) for _ in range(95)]
    out = bt.buffered_batches(spark.createDataFrame(list(enumerate(sizes)), "line long, src_len int"), "line", 20, 60, None).collect()
    got = {r.line: (r.buffer, r.batch_in_buffer) for r in out}
    for buf in range(5):
        lines = sorted((size, i) for i, size in enumerate(sizes) if i // 20 == buf)
        for b, ranks in enumerate(_batches_by_rule([x for x, _ in lines], 60, None, 1)):
            assert all(got[lines[r][1]] == (buf, b) for r in ranks)

"""Bigram tables on whole rows of token ids: counted on Arrow batches, and packed so that a worker holds all of a large one.

A packed part has the contexts ``ctx % parts``: for each its tokens in order (two bytes each where ids allow) and for each token
a byte that points to one of the context's different log-probabilities, the frequent ones first; the few beyond 255 are
listed apart.  Parts are broadcast one by one.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcorpus.constants import EOS
from seqcorpus.plans.broadcast import stored

#: Pairs of a part, pairs that a task holds while it counts, and bytes of all parts that a worker may hold.
PART_PAIRS, TASK_PAIRS, MAX_PACKED = 500_000, 1 << 18, 300 << 20
#: The code of a log-probability that is listed apart.
FAR = 255


def _contexts(lists):
    """(offsets from 0, previous tokens, tokens) of an Arrow array of lists."""
    at = np.asarray(lists.offsets, dtype=np.int64)
    at, tokens = at - at[0], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ctx = np.concatenate([[EOS], tokens[:-1]])[:len(tokens)]
    ctx[at[:-1][at[1:] > at[:-1]]] = EOS
    return at, ctx, tokens


def _counter(batches):
    import pyarrow as pa

    def added(held):
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(where, weights=np.concatenate([c for _, c in held]), minlength=len(keys)).astype(np.int64)

    def rows(keys, counts):
        for lo in range(0, len(keys), 1 << 16):
            k = keys[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)),
                                              pa.array(counts[lo:lo + (1 << 16)])], names=["ctx", "token", "c"])

    held, size = [], 0
    for batch in batches:
        _, ctx, tokens = _contexts(batch.column(0))
        if not len(tokens):
            continue
        keys, counts = np.unique(ctx << 32 | tokens, return_counts=True)
        held.append((keys, counts))
        size += len(keys)
        if size > 2 * TASK_PAIRS:
            held = [added(held)]
            size = len(held[0][0])
            if size > TASK_PAIRS:
                yield from rows(*held.pop())
                size = 0
    if held:
        yield from rows(*added(held))


def pair_counts(rows: DataFrame, tokens_col: str) -> DataFrame:
    """``(ctx, token, c)`` of all positions, the first context of a row being the sentence end."""
    part = rows.select(tokens_col).mapInArrow(_counter, "ctx int, token int, c long")
    return part.groupBy("ctx", "token").agg(F.sum("c").alias("c"))


def _packer(wide: bool):
    def run(key, table):
        import pyarrow as pa

        ctx, token, lp, lp0 = (table.column(c).to_numpy(zero_copy_only=False) for c in ("ctx", "token", "lp", "lp0"))
        order = np.lexsort((token, ctx))
        ctx, token, lp, lp0 = ctx[order], token[order], lp[order], lp0[order]
        names, starts = np.unique(ctx, return_index=True)
        codes, levels, level_at = np.empty(len(ctx), np.uint32), [], [0]
        for lo, hi in zip(starts, [*starts[1:], len(ctx)]):
            values, of, times = np.unique(lp[lo:hi], return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            codes[lo:hi] = np.argsort(order)[of]
            levels.append(values[order])
            level_at.append(level_at[-1] + len(values))
        far = np.flatnonzero(codes >= FAR)
        out = io.BytesIO()
        np.savez(out, names=names.astype(np.int32), starts=np.append(starts, len(ctx)), token=token.astype(np.uint32 if wide else np.uint16),
                 codes=np.minimum(codes, FAR).astype(np.uint8), far=far.astype(np.int32), far_code=codes[far], levels=np.concatenate(levels), level_at=np.array(level_at[:-1]), lp0=lp0[starts])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([out.getvalue()], pa.binary())})
    return run


def packed(model: DataFrame, unseen: DataFrame):
    """The broadcast parts of a model by ``ctx % parts``, or None if a worker can't hold them.  The model's plan runs once."""
    spark = model.sparkSession
    whole = stored(model.join(unseen.select("ctx", "lp0"), "ctx").select("ctx", "token", "lp", "lp0"))
    pairs, top, low = whole.agg(F.count(F.lit(1)), F.max("token"), F.min("token")).first()
    wide = (top or 0) > 0xFFFF
    if pairs * (5 if wide else 3) > MAX_PACKED or (low or 0) < 0:
        return None
    parts = max(1, -(-pairs // PART_PAIRS))
    made = stored(whole.groupBy(F.pmod("ctx", F.lit(parts)).cast("int").alias("part")).applyInArrow(_packer(wide), "part int, packed binary"))
    out = [None] * parts
    for row in made.toLocalIterator():  # a part at a time
        out[row.part] = spark.sparkContext.broadcast(dict(np.load(io.BytesIO(row.packed))))
    return out


def _looker(parts, column: int):
    def run(batches):
        import pyarrow as pa

        tables = [p.value if p is not None else None for p in parts]

        def look(t, ctx, token):
            at = np.minimum(np.searchsorted(t["names"], ctx), len(t["names"]) - 1)
            here = t["names"][at] == ctx
            lo, end = t["starts"][at], t["starts"][at + 1]
            hi, tokens = end.copy(), t["token"]
            while (lo < hi).any():
                mid = (lo + hi) >> 1
                less = (tokens[np.minimum(mid, len(tokens) - 1)] < token) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.maximum(np.minimum(mid, hi), lo))
            place = np.minimum(lo, len(tokens) - 1)
            seen = (lo < end) & (tokens[place] == token)
            code = np.where(seen, t["codes"][place], 0).astype(np.int64)
            far = np.flatnonzero(code == FAR)
            code[far] = t["far_code"][np.searchsorted(t["far"], place[far])]
            return np.where(seen, t["levels"][t["level_at"][at] + code], t["lp0"][at]), here

        for batch in batches:
            at, ctx, token = _contexts(batch.column(column))
            lps, known = np.empty(len(token)), np.zeros(len(token), bool)
            for k, t in enumerate(tables):
                mine = np.flatnonzero(ctx % len(tables) == k) if len(tables) > 1 else np.arange(len(token))
                if t is not None and len(mine):
                    lps[mine], known[mine] = look(t, ctx[mine], token[mine])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(lps, pa.float64(), mask=~known))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lps"])
    return run


def gathered(rows: DataFrame, tokens_col: str, parts) -> DataFrame:
    """The rows with ``lps``, the log-probability of each token after the one before it.  Nothing is shuffled."""
    schema = T.StructType(rows.schema.fields + [T.StructField("lps", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_looker(parts, rows.columns.index(tokens_col)), schema)

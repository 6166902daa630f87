"""Length filters, ordering and token-budget batching: FLT-01..04, SRT-01..04, BAT-01..06,
AGG-29, WIN-15, JN-11.

BAT-01 (greedy token-budget batches) is exact and distributed.  The greedy loop only looks at
each row's cost ``num_tokens = max(src_len, tgt_len)`` in the order (src_len, tgt_len, id), so the
input is a run-length list over (src_len, tgt_len).  The run histogram - bounded by the length
caps, max_src x max_tgt, never by the row count - is replayed on the driver; inside a run the
loop becomes periodic (every m rows emit one batch of m rows), so a run costs O(1) segments plus
the few rows needed to flush rows carried over from earlier runs.  Rows then get their batch by
arithmetic on their global rank: the segment table is joined on the run key (broadcast when its
size is proven small, a shuffle join otherwise) and filtered to the segment's rank range.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcorpus.plans.broadcast import maybe_broadcast
from seqcorpus.plans.index import global_index

_INF = float("inf")


def valid_size(df: DataFrame, max_src: int, max_tgt: int | None, src_len: str = "src_len",
               tgt_len: str = "tgt_len") -> DataFrame:
    """FLT-01: ``src_len <= max_src`` and (no target or ``tgt_len <= max_tgt``)."""
    cond = F.col(src_len) <= max_src
    if max_tgt is not None and tgt_len in df.columns:
        cond = cond & (F.col(tgt_len).isNull() | (F.col(tgt_len) <= max_tgt))
    return df.filter(cond)


def invalid_report(df: DataFrame, max_src: int, max_tgt: int | None, order_cols: list[str],
                   id_col: str, mode: str = "skip", src_len: str = "src_len", tgt_len: str = "tgt_len") -> DataFrame:
    """FLT-02: rows failing FLT-01: their count and the first 10 ids in batching order.
    ``mode='raise'`` raises when any row is invalid."""
    cond = F.col(src_len) <= max_src
    if max_tgt is not None:
        cond = cond & (F.col(tgt_len).isNull() | (F.col(tgt_len) <= max_tgt))
    bad = df.filter(~cond)
    n = bad.count()
    if mode == "raise" and n > 0:
        raise ValueError(f"{n} rows are longer than allowed (source {max_src}, target {max_tgt})")
    first = bad.orderBy(*order_cols).limit(10).select(id_col)
    return first.agg(F.lit(n).cast("long").alias("n_invalid"),
                     F.array_join(F.transform(F.collect_list(id_col), lambda x: x.cast("string")), " ").alias("_ids"))


def clean_corpus(df: DataFrame, src_words: str, tgt_words: str, min_len: int, max_len: int,
                 ratio: float | None) -> DataFrame:
    """FLT-03: drop pairs with a side outside [min_len, max_len] words or a length ratio over
    ``ratio`` either way."""
    s, t = F.size(src_words), F.size(tgt_words)
    cond = (s >= min_len) & (s <= max_len) & (t >= min_len) & (t <= max_len) & (s > 0) & (t > 0)
    if ratio is not None:
        cond = cond & (s / t <= ratio) & (t / s <= ratio)
    return df.filter(cond)


def modulo_split(df: DataFrame, order_cols: list[str], k: int, name: str = "split") -> DataFrame:
    """FLT-04: 1-based row number (after cleaning, in ``order_cols``) divisible by k → 'valid'."""
    idx = global_index(df, order_cols, name="_rn")
    return idx.withColumn(name, F.when((F.col("_rn") + 1) % k == 0, "valid").otherwise("train")).drop("_rn")


def length_order(df: DataFrame, id_cols: list[str], src_len: str = "src_len", tgt_len: str | None = "tgt_len",
                 name: str = "ord", seed: int | None = None) -> DataFrame:
    """SRT-01: stable order by src_len, then tgt_len, ties by id (or by a seeded hash when shuffling)."""
    ties = [F.xxhash64(*[F.col(c) for c in id_cols], F.lit(seed))] if seed is not None else []
    order = [F.col(src_len)] + ([F.col(tgt_len)] if tgt_len else []) + ties + [F.col(c) for c in id_cols]
    return global_index(df, order, name=name)


# --------------------------------------------------------------------------- BAT-01
#: Pairs of lengths that the driver plans with: all pairs under caps of 1024.
MAX_RUNS = 1025 * 1025


def _flush_size(k: int, mult: int) -> int:
    return max(mult * (k // mult), k % mult)


def plan_segments(runs, max_tokens, max_sentences, mult: int = 1):
    """Replay the greedy loop over ``runs = [(cost, count), ...]`` (in batching order).

    Returns ``[(start_rank, size, repeat), ...]``: batches ``start + j*size .. +size`` for
    j < repeat, consecutive and covering every rank once.  The open batch is kept run-length
    encoded, so a run costs O(1) work plus per-row steps only while rows carried over from an
    earlier, costlier run are still in the batch."""
    T = _INF if max_tokens is None else max_tokens
    S = _INF if max_sentences is None else max_sentences
    segs = []
    q: deque = deque()  # [cost, count] of the open batch, front = oldest
    k = 0
    start = 0

    def pop_front(m):
        while m > 0:
            head = q[0]
            take = min(m, head[1])
            head[1] -= take
            m -= take
            if head[1] == 0:
                q.popleft()

    def push(v, n):
        if q and q[-1][0] == v:
            q[-1][1] += n
        else:
            q.append([v, n])

    def one_row(v):
        nonlocal k, start
        if k > 0:
            ml = max(max(c[0] for c in q), v)
            if k == S or (k + 1) * ml > T:
                m = _flush_size(k, mult)
                segs.append((start, m, 1))
                start += m
                pop_front(m)
                k -= m
        push(v, 1)
        k += 1

    for v, c in runs:
        left = c
        while left > 0 and k > 0 and max(x[0] for x in q) > v:
            one_row(v)
            left -= 1
        if left == 0:
            continue
        K = S if T == _INF else min(S, max(1, T // v))
        if K == _INF:
            push(v, left)
            k += left
            continue
        K = int(K)
        while left > 0 and k > K:
            one_row(v)
            left -= 1
        if left > 0 and k < K:
            take = min(left, K - k)
            push(v, take)
            k += take
            left -= take
        if left > 0:
            m = _flush_size(K, mult)
            e = (left - 1) // m + 1
            segs.append((start, m, e))
            start += e * m
            push(v, left)
            pop_front(e * m)
            k = K + left - e * m
    if k > 0:
        segs.append((start, k, 1))
    return segs


def token_budget_batches(df: DataFrame, id_cols: list[str], max_tokens: int | None,
                         max_sentences: int | None = None, mult: int = 1, src_len: str = "src_len",
                         tgt_len: str | None = "tgt_len", batch_col: str = "batch_id") -> DataFrame:
    """BAT-01 (+JN-11): greedy batches over the (src_len, tgt_len, id) order.

    Adds ``batch_id`` (0-based, in emission order), ``pos_in_batch`` and ``rank``.  The driver holds one row for each
    (src_len, tgt_len) that occurs, at most ``MAX_RUNS``: filter by ``valid_size`` first; more is an error."""
    spark = df.sparkSession
    tkey = F.coalesce(F.col(tgt_len), F.lit(-1)) if tgt_len else F.lit(-1)
    keyed = df.withColumn("_tk", tkey)
    hist = keyed.groupBy(src_len, "_tk").agg(F.count(F.lit(1)).alias("_n"))
    runs = [(int(r[0]), int(r[1]), int(r[2])) for r in hist.orderBy(src_len, "_tk").limit(MAX_RUNS + 1).collect()]
    if len(runs) > MAX_RUNS:
        raise ValueError(f"over {MAX_RUNS} different pairs of lengths: filter by valid_size first")
    segs = plan_segments([(max(s, t, 0), n) for s, t, n in runs], max_tokens, max_sentences, mult)
    # segments x runs overlap table (two-pointer sweep over rank ranges)
    rows, first_batch, si, run_start = [], [], 0, 0
    acc = 0
    for st, m, e in segs:
        first_batch.append(acc)
        acc += e
    for s, t, n in runs:
        lo, hi = run_start, run_start + n
        while si < len(segs) and segs[si][0] + segs[si][1] * segs[si][2] <= lo:
            si += 1
        j = si
        while j < len(segs) and segs[j][0] < hi:
            st, m, e = segs[j]
            rows.append((s, t, st, m, e, first_batch[j]))
            if st + m * e > hi:
                break
            j += 1
        run_start = hi
    seg_df = spark.createDataFrame(rows, f"{src_len} int, _tk int, _s long, _m long, _e long, _fb long")
    order = [F.col(src_len), F.col("_tk")] + [F.col(c) for c in id_cols]
    ranked = global_index(keyed, order, name="rank")
    j = ranked.join(maybe_broadcast(seg_df), [src_len, "_tk"])
    off = F.col("rank") - F.col("_s")
    j = j.filter((off >= 0) & (off < F.col("_m") * F.col("_e")))
    return (j.withColumn(batch_col, (F.col("_fb") + F.floor(off / F.col("_m"))).cast("long"))
            .withColumn("pos_in_batch", (off % F.col("_m")).cast("int"))
            .drop("_tk", "_s", "_m", "_e", "_fb"))


def buffered_batches(df: DataFrame, line_col: str, size: int, max_tokens: int | None,
                     max_sentences: int | None, src_len: str = "src_len") -> DataFrame:
    """BAT-05: lines taken ``size`` at a time (by ``line_col`` order), each buffer batched on its own
    (greedy over source length, ties by line).  A buffer is at most ``size`` rows, so the per-buffer
    loop runs as a bounded grouped-map task."""
    import numpy as np
    import pandas as pd

    T, S = max_tokens, max_sentences
    schema = f"{line_col} long, buffer long, batch_in_buffer long"

    def per_buffer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([src_len, line_col], kind="mergesort")
        lengths = pdf[src_len].value_counts(sort=False).sort_index()
        sizes = np.array([size for _, size, times in plan_segments(list(lengths.items()), T, S, 1) for _ in range(times)], np.int64)
        lab = np.repeat(np.arange(len(sizes)), sizes)
        return pd.DataFrame({line_col: pdf[line_col].astype("int64").values,
                             "buffer": pdf["buffer"].astype("int64").values,
                             "batch_in_buffer": pd.Series(lab, dtype="int64").values})

    buf = df.select(line_col, src_len, F.floor(F.col(line_col) / size).cast("long").alias("buffer"))
    return buf.groupBy("buffer").applyInPandas(per_buffer, schema)


def collate(batched: DataFrame, batch_col: str = "batch_id", src: str = "src_ids", tgt: str | None = "tgt_ids",
            id_cols: list[str] | None = None, left_pad_source: bool = True, left_pad_target: bool = False,
            others: dict[str, str] | None = None) -> DataFrame:
    """BAT-02 + SRT-04 + PRJ-09/10: per row its batch-padded source, target and decoder input,
    and its place in the batch (source length desc, then id).  Windows are partitioned by batch
    (a batch is bounded by the token budget).

    ``others`` (3- and 4-way rows) names further id columns and the columns they are padded into, e.g.
    ``{"pivot_ids": "pivot", "mt_ids": "mt"}``: always padded on the right, to the longest of the batch; a null one is all pads."""
    from pyspark.sql import Window

    from seqcorpus.functions.arrays import pad_to, shift_eos_first

    w = Window.partitionBy(batch_col)
    order = [F.size(src).desc()] + [F.col(c) for c in (id_cols or [])]
    out = (batched.withColumn("_ms", F.max(F.size(src)).over(w))
           .withColumn("row_in_batch", (F.row_number().over(w.orderBy(*order)) - 1).cast("int"))
           .withColumn("source", pad_to(src, F.col("_ms"), left_pad_source)))
    if tgt:
        out = (out.withColumn("_mt", F.max(F.size(tgt)).over(w))
               .withColumn("target", pad_to(tgt, F.col("_mt"), left_pad_target))
               .withColumn("prev_output", pad_to(shift_eos_first(tgt), F.col("_mt"), left_pad_target))
               .drop("_mt"))
    for col, name in (others or {}).items():
        ids = F.coalesce(F.col(col), F.slice(F.col(src), 1, 0))
        out = out.withColumn("_mo", F.max(F.size(ids)).over(w)).withColumn(name, pad_to(ids, F.col("_mo"), False)).drop("_mo")
    return out.drop("_ms")


def lm_order(sizes: DataFrame, id_cols: list[str], size: str = "size", mirrored: bool = False) -> DataFrame:
    """SRT-02: ``idx`` (place in the corpus by ``id_cols``) and ``ord`` (place in the order by size, ties by idx).

    ``mirrored`` orders row i by the size of row N-1-i: an array of sizes that was turned over as a whole, where a falling order was
    meant.  Both orders are global numberings; the mirrored one adds an equi-join on the index."""
    rows = global_index(sizes, id_cols, name="idx")
    if not mirrored:
        return global_index(rows, [size, "idx"], name="ord")
    n = rows.count()  # one scalar
    other = rows.select((F.lit(n - 1) - F.col("idx")).alias("idx"), F.col(size).alias("_key"))
    return global_index(rows.join(other, "idx"), ["_key", "idx"], name="ord").drop("_key")


def batch_summary(batched: DataFrame, batch_col: str = "batch_id", src_len: str = "src_len",
                  tgt_len: str | None = "tgt_len") -> DataFrame:
    """BAT-02 / AGG-29: rows, padded sizes and ``ntokens`` (target length sum, or source when no
    target) per batch."""
    nt = F.sum(F.coalesce(F.col(tgt_len), F.col(src_len))) if tgt_len else F.sum(src_len)
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max(src_len).alias("max_src"), nt.cast("long").alias("ntokens")]
    if tgt_len:
        aggs.append(F.max(tgt_len).alias("max_tgt"))
    return batched.groupBy(batch_col).agg(*aggs)


def shard(batches: DataFrame, n: int, batch_col: str = "batch_id") -> DataFrame:
    """BAT-03: batch b goes to shard b % n at slot b // n; every shard gets ceil(B/n) slots, the
    missing ones are empty batches (null id)."""
    spark = batches.sparkSession
    b = batches.select(batch_col).distinct().count()  # one scalar
    slots = -(-b // n) * n
    grid = spark.range(slots).select(F.col("id").alias(batch_col))
    have = batches.select(batch_col).distinct().withColumn("_has", F.lit(True))
    return (grid.join(have, batch_col, "left")
            .select((F.col(batch_col) % n).cast("int").alias("shard"), (F.col(batch_col) / n).cast("long").alias("slot"),
                    F.when(F.col("_has"), F.col(batch_col)).alias(batch_col)))


def accumulate(batches: DataFrame, update_freq: list[int], epoch: int = 1, batch_col: str = "batch_id") -> DataFrame:
    """BAT-04: in epoch e every N_e consecutive batches form one update (list per epoch, the last
    value repeats); the epoch's final batch closes the last, possibly short, update."""
    n = update_freq[epoch - 1] if epoch <= len(update_freq) else update_freq[-1]
    return batches.withColumn("update_id", F.floor(F.col(batch_col) / n).cast("long"))


def maxlen_bound(summary: DataFrame, a: float, b: int, max_src: str = "max_src") -> DataFrame:
    """BAT-06: decode length bound ``int(a * padded_src_len + b)`` per batch."""
    return summary.withColumn("maxlen", (F.lit(a) * F.col(max_src) + F.lit(b)).cast("long"))


def epoch_shuffle(batches: DataFrame, seed: int, epoch: int, batch_col: str = "batch_id") -> DataFrame:
    """SRT-03: deterministic permutation of batches keyed by ``seed + epoch``."""
    return global_index(batches, [F.xxhash64(F.col(batch_col), F.lit(seed + epoch)), F.col(batch_col)],
                        name="epoch_ord")


def resume_position(batches: DataFrame, k: int, epoch: int, ord_col: str = "epoch_ord") -> DataFrame:
    """WIN-15: continue an epoch after k consumed batches; k >= number of batches starts the
    next epoch from its first batch.  Returns the batches still to run with their epoch."""
    total = batches.count()  # one scalar
    if k >= total:
        return batches.withColumn("epoch", F.lit(epoch + 1)).withColumn("offset", F.lit(0))
    return (batches.filter(F.col(ord_col) >= k).withColumn("epoch", F.lit(epoch))
            .withColumn("offset", F.lit(k)))

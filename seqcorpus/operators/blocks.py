"""Token blocks over sentence streams: WIN-06 ('none'), WIN-07 ('complete'), WIN-08 ('eos'),
WIN-09 (language-model shift), FLT-05.

A stream is every sentence of one key (e.g. a language) in a total order; its token positions
come from ``global_cumsum`` (range-partitioned, no per-stream task).

'complete' blocks are a greedy chain: ``next(i)`` = first sentence that no longer fits with the
block starting at i.  Every sentence holds >= 1 token, so ``next(i) <= i + B + 1``.  Each stream is cut
into chunks of a fixed number of sentences; a grouped task per chunk (its rows plus the first B+1 rows of
the next chunk as look-ahead) computes ``next`` with a binary search on prefix sums and, by a backward
scan, the exit of the chain for each possible entry (only the first B+1 sentences of a chunk can be
entries).  Where the chain enters each chunk follows by joins alone: going up, the maps of two
neighbours are composed (entry of the left to exit of the right) until one map covers the stream; going
down, the entry of a pair gives that of its right half.  Both take log2(chunks) joins, and no table of chunks
comes to the driver.  A last grouped task labels the sentences of each chunk from its entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcorpus.plans.broadcast import maybe_broadcast
from seqcorpus.plans.index import global_positions
from seqcorpus.plans.session import cut_lineage

#: Sentences of a chunk.
CHUNK = 1 << 16


def stream_positions(sent: DataFrame, stream: str, order_cols: list[str], size_col: str = "size") -> DataFrame:
    """Adds ``start_pos`` (token offset of the sentence inside its stream) and ``sent_no``."""
    idx = global_positions(sent, [F.col(stream)] + [F.col(c) for c in order_cols], size_col, "_gidx", "_gpos")
    base = idx.groupBy(stream).agg(F.min("_gpos").alias("_p0"), F.min("_gidx").alias("_i0"))
    return (idx.join(maybe_broadcast(base), stream)
            .withColumn("start_pos", F.col("_gpos") - F.col("_p0"))
            .withColumn("sent_no", F.col("_gidx") - F.col("_i0"))
            .drop("_gpos", "_p0", "_gidx", "_i0"))


def blocks_none(sent: DataFrame, stream: str, order_cols: list[str], block_size: int,
                ids_col: str = "ids") -> DataFrame:
    """WIN-06: fixed windows ``[iB, min((i+1)B, N))`` over the stream's tokens.

    Each sentence is cut into the pieces that fall into each block it touches; the pieces are
    regrouped per (stream, block) - a block holds at most B tokens."""
    B = block_size
    s = stream_positions(sent.withColumn("size", F.size(ids_col)), stream, order_cols)
    first_b = F.floor(F.col("start_pos") / B)
    last_b = F.floor((F.col("start_pos") + F.col("size") - 1) / B)
    pieces = s.filter(F.col("size") > 0).select(
        stream, "start_pos", ids_col, F.explode(F.sequence(first_b, last_b)).alias("block_id"))
    lo = F.greatest(F.col("start_pos"), F.col("block_id") * B)
    hi = F.least(F.col("start_pos") + F.size(ids_col), (F.col("block_id") + 1) * B)
    pieces = pieces.select(stream, F.col("block_id").cast("long"), lo.alias("lo"),
                           F.slice(ids_col, (lo - F.col("start_pos") + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    return (pieces.groupBy(stream, "block_id")
            .agg(F.min("lo").alias("start_pos"),
                 F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "piece"))), lambda x: x["piece"])).alias("ids"))
            .withColumn("end_pos", F.col("start_pos") + F.size("ids")))


def _next_array(sizes: np.ndarray, B: int) -> np.ndarray:
    p = np.concatenate([[0], np.cumsum(sizes)])
    nxt = np.searchsorted(p, p[:-1] + B, side="right") - 1
    return np.maximum(nxt, np.arange(len(sizes)) + 1)


def chunk_entries(table: DataFrame, stream: str) -> DataFrame:
    """``(stream, _chunk, _entry, _boff)``: the sentence at which the chain of blocks enters each chunk, and the number of blocks
    before it, from ``table`` (stream, _chunk, entry, exit, nblocks).  A chain that ends before a chunk enters it behind its end."""
    chunks = (table.agg(F.max("_chunk")).first()[0] or 0) + 1  # one scalar
    levels = [table.withColumnRenamed("_chunk", "g")]
    while 1 << (len(levels) - 1) < chunks:
        low = levels[-1]
        left = low.where(F.col("g") % 2 == 0).withColumn("g", F.shiftright("g", 1))
        right = low.where(F.col("g") % 2 == 1).select(stream, F.shiftright("g", 1).alias("g"), F.col("entry").alias("exit"), F.col("exit").alias("_x"), F.col("nblocks").alias("_n"))
        both = left.join(right, [stream, "g", "exit"], "left")
        levels.append(cut_lineage(both.select(stream, "g", "entry", F.coalesce("_x", "exit").alias("exit"), (F.col("nblocks") + F.coalesce("_n", F.lit(0))).alias("nblocks"))))
    at = table.select(stream).distinct().select(stream, F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))
    for low in reversed(levels[:-1]):
        # both halves come out of one join and each level is written: otherwise the plan doubles with every level
        through = at.withColumn("g", F.col("g") * 2).join(low, [stream, "g", "entry"], "left")
        halves = F.array(F.struct("g", "entry", "before"),
                         F.struct((F.col("g") + 1).alias("g"), F.coalesce("exit", "entry").alias("entry"), (F.col("before") + F.coalesce("nblocks", F.lit(0))).alias("before")))
        at = cut_lineage(through.select(stream, F.explode(halves).alias("h")).select(stream, "h.*"))
    return at.select(stream, F.col("g").alias("_chunk"), F.col("entry").alias("_entry"), F.col("before").alias("_boff"))


def blocks_complete(sent: DataFrame, stream: str, order_cols: list[str], block_size: int,
                    size_col: str = "size", chunk_sentences: int | None = None) -> DataFrame:
    """WIN-07: greedy blocks of whole sentences, total <= B; an over-long sentence is a block alone.

    Returns the input rows with ``sent_no``, ``start_pos`` and ``block_id`` (0-based per stream)."""
    B = block_size
    s = stream_positions(sent, stream, order_cols, size_col)
    C = max(B + 1, chunk_sentences or CHUNK)
    s = cut_lineage(s)
    s = s.withColumn("_chunk", F.floor(F.col("sent_no") / C).cast("long"))
    own = s.select(stream, "_chunk", "sent_no", F.col(size_col).cast("long").alias("_sz"), F.lit(False).alias("_ahead"))
    ahead = (s.filter((F.col("sent_no") % C <= B) & (F.col("_chunk") > 0))
             .select(stream, (F.col("_chunk") - 1).alias("_chunk"), "sent_no", F.col(size_col).cast("long").alias("_sz"),
                     F.lit(True).alias("_ahead")))
    work = own.unionByName(ahead)
    stype = dict(s.dtypes)[stream]

    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sent_no")
        sizes = pdf["_sz"].to_numpy()
        nos = pdf["sent_no"].to_numpy()
        n_own = int((~pdf["_ahead"].to_numpy()).sum())
        nxt = _next_array(sizes, B)
        exit_ = np.empty(n_own, dtype=np.int64)
        nblk = np.empty(n_own, dtype=np.int64)
        for i in range(n_own - 1, -1, -1):
            j = nxt[i]
            if j >= n_own:
                exit_[i] = nos[j] if j < len(nos) else nos[-1] + 1  # past the last row: the stream ends there
                nblk[i] = 1
            else:
                exit_[i] = exit_[j]
                nblk[i] = nblk[j] + 1
        k = min(n_own, B + 1)
        return pd.DataFrame({stream: pdf[stream].iloc[:k].values, "_chunk": pdf["_chunk"].iloc[:k].values,
                             "entry": nos[:k], "exit": exit_[:k], "nblocks": nblk[:k]})

    table = work.groupBy(stream, "_chunk").applyInPandas(
        entries, f"{stream} {stype}, _chunk long, entry long, exit long, nblocks long")
    plan_df = chunk_entries(cut_lineage(table), stream)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sent_no")
        sizes = pdf["_sz"].to_numpy()
        nos = pdf["sent_no"].to_numpy()
        own_mask = ~pdf["_ahead"].to_numpy()
        n_own = int(own_mask.sum())
        entry, boff = int(pdf["_entry"].iloc[0]), int(pdf["_boff"].iloc[0])
        nxt = _next_array(sizes, B)
        lab = np.full(n_own, boff - 1, dtype=np.int64)
        i = int(entry - nos[0])
        b = boff
        while i < n_own:
            j = min(int(nxt[i]), n_own)
            lab[i:j] = b
            b += 1
            i = j
        return pd.DataFrame({stream: pdf[stream].iloc[:n_own].values, "sent_no": nos[:n_own], "block_id": lab})

    labelled = (work.join(maybe_broadcast(plan_df), [stream, "_chunk"])
                .groupBy(stream, "_chunk")
                .applyInPandas(label, f"{stream} {stype}, sent_no long, block_id long"))
    return s.drop("_chunk").join(labelled, [stream, "sent_no"])


def blocks_eos(sent: DataFrame, size_col: str = "size") -> DataFrame:
    """WIN-08 + FLT-05: one block per sentence, skipping sentences of length <= 1."""
    return sent.filter(F.col(size_col) > 1)


def lm_shift(blocks: DataFrame, stream: str, block_col: str = "block_id", ids_col: str = "ids") -> DataFrame:
    """WIN-09: ``source[t] = stream[t-1]``; the very first source token is the stream's last token.

    The previous block's last token arrives by an equi-join on (stream, block_id + 1), the stream's
    last token by a per-stream aggregate - no window over a whole stream."""
    last = blocks.select(stream, (F.col(block_col) + 1).alias(block_col), F.element_at(ids_col, -1).alias("_prev"))
    tail = blocks.groupBy(stream).agg(F.max_by(F.element_at(ids_col, -1), F.col(block_col)).alias("_last"))
    j = blocks.join(last, [stream, block_col], "left").join(tail, stream)
    first = F.when(F.col(block_col) == 0, F.col("_last")).otherwise(F.col("_prev"))
    return (j.withColumn("source", F.concat(F.array(first), F.slice(ids_col, 1, F.size(ids_col) - 1)))
            .withColumnRenamed(ids_col, "target").drop("_prev", "_last"))

"""Vocabulary operators: AGG-01..05, FLT-09, WIN-01, SRT-05, SET-03/04, JN-13.

A vocabulary is a DataFrame ``(id INT, symbol STRING, count BIGINT)`` with the four reserved
entries at ids 0..3.  Words are counted on Arrow batches and added up in the task, then by one hash aggregation on the
symbol, so a word holding a third of all tokens collapses map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqcorpus.constants import EOS_WORD, MADEUP_PREFIX, NSPECIAL, SPECIAL_SYMBOLS, UNK, UNK_WORD
from seqcorpus.functions.text import arrow_words, tokenize
from seqcorpus.plans.broadcast import maybe_broadcast, stored
from seqcorpus.plans.index import global_index
from seqcorpus.plans.keys import LONG_DIGITS, digit_widths, packed_key, unpack_key

VOCAB_SCHEMA = "id INT, symbol STRING, count BIGINT"
#: Entries of a vocabulary that the driver ranks; a larger one gets its ids from the distributed index.
DRIVER_WORDS = 1 << 17
#: Different words that a task holds before it hands them on.
TASK_WORDS = 1 << 17


def explode_tokens(lines: DataFrame, order_cols: list[str], text_col: str = "text",
                   tokens_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per token: ``order_cols`` + ``keep`` + ``pos`` (0-based) + ``symbol``."""
    toks = F.col(tokens_col) if tokens_col else tokenize(text_col)
    cols = list(dict.fromkeys(list(order_cols) + list(keep or [])))
    return lines.select(*cols, F.posexplode(toks).alias("pos", "symbol"))


def _counter(scale: int, ends: bool = True):
    """Arrow batches of (row key, text or words) -> ``(symbol, count, _k)``: a word's occurrences and the smallest ``row key * scale + pos`` of
    them, and with ``ends`` one end of sentence for each row.  A row without a key counts but has no place."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        none = np.iinfo(np.int64).max
        schema = pa.schema([("symbol", pa.string()), ("count", pa.int64()), ("_k", pa.int64())])

        def added(held):
            t = pa.concat_tables(held).group_by("symbol").aggregate([("count", "sum"), ("_k", "min")])
            return t.select(["symbol", "count_sum", "_k_min"]).rename_columns(schema.names)

        def table(symbols, counts, keys):
            return pa.Table.from_arrays([symbols, pa.array(counts, pa.int64()), pa.array(keys, pa.int64(), mask=keys == none)], schema=schema)

        held, rows, lines = [], 0, 0
        for batch in batches:
            column = batch.column(1)
            lines += len(column) - column.null_count
            if pa.types.is_list(column.type):
                sizes, words = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()
            else:
                offsets, words = arrow_words(column)
                sizes = np.diff(offsets)
            words = words.dictionary_encode(null_encoding="encode")
            if not len(words):
                continue
            row = np.repeat(np.arange(len(sizes)), sizes)
            keys = batch.column(0).fill_null(none).to_numpy(zero_copy_only=False)[row]
            pos = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
            keys = np.where(keys == none, none, np.where(keys == none, 0, keys) * scale + pos)
            codes = words.indices.to_numpy(zero_copy_only=False)
            counts = np.bincount(codes, minlength=len(words.dictionary))
            if (keys[1:] < keys[:-1]).any():
                order = np.argsort(keys, kind="stable")
                keys, codes = keys[order], codes[order]
            first = np.full(len(counts), none)
            first[codes[::-1]] = keys[::-1]  # of several the last written one stays, the smallest
            held.append(table(words.dictionary, counts, first))
            rows += len(counts)
            if rows > 2 * TASK_WORDS:
                held = [added(held)]
                rows = held[0].num_rows
                if rows > TASK_WORDS:
                    yield from held.pop().to_batches(1 << 16)
                    rows = 0
        if ends:
            held.append(table(pa.array([EOS_WORD]), np.array([lines]), np.array([none])))
        elif not held:
            return
        yield from added(held).to_batches(1 << 16)
    return run


def count_pieces(rows: DataFrame, pieces_col: str) -> DataFrame:
    """``(symbol, count)`` of the strings in an array column."""
    part = rows.select(F.lit(0).cast("long").alias("_row"), pieces_col).mapInArrow(_counter(1, ends=False), "symbol string, count long, _k long")
    return part.groupBy("symbol").agg(F.sum("count").alias("count"))


def count_words(lines: DataFrame, order_cols: list[str], text_col: str = "text",
                tokens_col: str | None = None) -> DataFrame:
    """AGG-01: ``(symbol, count, first)``; +1 end-of-sentence per line; the reserved symbols start at 1.

    ``first`` = position of the first occurrence (struct of ``order_cols`` + ``pos``), the tie
    breaker that reproduces first-seen order.  Reserved symbols carry a null ``first``.  The
    first-seen minimum is taken over a packed BIGINT key when the positions fit 18 digits: tasks then count Arrow
    batches.  Up to 38 digits it is a DECIMAL, and the count is one partial + final hash aggregation of exploded
    words (a hot word is one row per task).
    """
    spark = lines.sparkSession
    toks_col = F.col(tokens_col) if tokens_col else tokenize(text_col)
    # a line has fewer tokens than characters: bound the position width without tokenising
    n_bound = F.size(toks_col) if tokens_col else F.length(text_col)
    widths = digit_widths(lines.select(*order_cols, n_bound.alias("_n")), list(order_cols) + ["_n"])
    names = list(order_cols) + ["pos"]
    dtypes = dict(lines.dtypes) | {"pos": "int"}
    seed = spark.createDataFrame([(s_,) for s_ in SPECIAL_SYMBOLS], "symbol string")
    special_set = F.col("symbol").isin(SPECIAL_SYMBOLS)
    unpacked = lambda: F.struct(*[c.cast(dtypes[n]).alias(n) for c, n in zip(unpack_key("_k", widths, names), names)])
    # one pass: every line contributes its tokens and one end-of-sentence; the reserved symbols
    # enter with their initial count of 1 as four extra rows of the same aggregation
    if widths is not None and sum(widths) <= LONG_DIGITS:
        rows = lines.select(packed_key(list(order_cols), widths[:-1]).alias("_row"), F.col(tokens_col or text_col).alias("_words"))
        part = rows.mapInArrow(_counter(10 ** widths[-1]), "symbol string, count long, _k long")
        part = part.unionByName(seed.select("symbol", F.lit(1).cast("long").alias("count"), F.lit(None).cast("long").alias("_k")))
        words = part.groupBy("symbol").agg(F.sum("count").alias("count"), F.min("_k").alias("_k"))
        first = unpacked()
    else:
        toks = lines.select(*order_cols, F.posexplode(F.concat(toks_col, F.array(F.lit(EOS_WORD)))).alias("pos", "symbol"))
        seed = seed.select(*[F.lit(None).cast(dtypes[n]).alias(n) for n in names], "symbol")
        allrows = toks.select(*names, "symbol").unionByName(seed)
        if widths is not None:
            words = allrows.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"), F.min(packed_key(names, widths)).alias("_k"))
            first = unpacked()
        else:
            words = allrows.groupBy("symbol").agg(F.count(F.lit(1)).alias("count"),
                                                  F.min(F.struct(*[F.col(c) for c in names])).alias("_k"))
            first = F.col("_k")
    # reserved symbols: their first position is irrelevant
    return words.select("symbol", F.col("count").cast("long").alias("count"),
                        F.when(~special_set, first).alias("first"))


def finalize_vocab(counts: DataFrame, threshold: int = -1, nwords: int = -1,
                   padding_factor: int = 8) -> DataFrame:
    """AGG-04 + WIN-01 + FLT-09: reserved ids first, then words by count desc / first seen,
    at most ``nwords`` entries in total, dropping counts below ``threshold``, padded with
    ``madeupwordNNNN`` (count 0) to a multiple of ``padding_factor``.

    The counts are made once and written.  With ``nwords`` up to ``DRIVER_WORDS`` the top-n is a TakeOrderedAndProject
    whose result is bounded by nwords; it is brought back once and becomes a small local table (cheap to broadcast, never
    recomputed by its consumers).  Without ``nwords``, or above that bound, the rank comes from ``global_index``
    (range-partitioned and checkpointed, never one task), and the driver holds no words.
    """
    spark = counts.sparkSession
    counts = stored(counts)
    is_special = F.col("symbol").isin(SPECIAL_SYMBOLS)
    spec_counts = {r[0]: int(r[1]) for r in counts.filter(is_special).select("symbol", "count").collect()}
    specials = [(i, s_, spec_counts.get(s_, 1)) for i, s_ in enumerate(SPECIAL_SYMBOLS)]
    words = counts.filter(~is_special).filter(F.col("count") >= F.lit(threshold))
    order = [F.col("count").desc(), F.col("first").asc(), F.col("symbol").asc()]

    def pads(n):
        if not padding_factor or padding_factor <= 1:
            return []
        k = (-n) % padding_factor
        return [(n + i, f"{MADEUP_PREFIX}{i:04d}", 0) for i in range(k)]

    keep = max(nwords - NSPECIAL, 0)
    if 0 < nwords <= DRIVER_WORDS:
        top = words.orderBy(*order).limit(keep).select("symbol", "count").collect()  # <= nwords rows
        rows = specials + [(NSPECIAL + i, r[0], int(r[1])) for i, r in enumerate(top)]
        rows += pads(len(rows))
        return spark.createDataFrame(rows, VOCAB_SCHEMA)
    ranked = global_index(words.select("symbol", "count", "first"), order, name="_r")
    if nwords > 0:
        ranked = ranked.where(F.col("_r") < keep)
    ranked = ranked.select((F.col("_r") + NSPECIAL).cast("int").alias("id"), "symbol", F.col("count").cast("long"))
    n = NSPECIAL + ranked.count()
    small = spark.createDataFrame(specials + pads(n), VOCAB_SCHEMA)
    return small.unionByName(ranked)


def build_vocab(lines: DataFrame, order_cols: list[str], threshold: int = -1, nwords: int = -1,
                padding_factor: int = 8, text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    return finalize_vocab(count_words(lines, order_cols, text_col, tokens_col), threshold, nwords, padding_factor)


def merge_vocab(left: DataFrame, right: DataFrame) -> DataFrame:
    """AGG-02: ``left.update(right)``: counts of shared symbols add up (reserved ones included);
    symbols only in ``right`` are appended in right's id order with right's count."""
    l = left.select("id", "symbol", F.col("count").alias("lc"))
    r = right.select(F.col("id").alias("rid"), "symbol", F.col("count").alias("rc"))
    j = l.join(r, "symbol", "full_outer")
    top = left.agg(F.max("id")).first()[0]  # one scalar
    shared = j.filter(F.col("id").isNotNull()).select(
        "id", "symbol", (F.col("lc") + F.coalesce(F.col("rc"), F.lit(0))).cast("long").alias("count"))
    new = j.filter(F.col("id").isNull()).select("rid", "symbol", "rc")
    new = (global_index(new, ["rid"], name="_r")
           .select((F.lit(top + 1) + F.col("_r")).cast("int").alias("id"), "symbol",
                   F.col("rc").cast("long").alias("count")))
    return shared.unionByName(new)


def top_n_words(counts: DataFrame, n: int) -> DataFrame:
    """SRT-05: the n most common non-reserved words (count desc, first seen)."""
    return (counts.filter(~F.col("symbol").isin(SPECIAL_SYMBOLS))
            .orderBy(F.col("count").desc(), F.col("first").asc(), F.col("symbol").asc()).limit(n)
            .select("symbol", "count"))


def min_count_threshold(vocab: DataFrame, threshold: int) -> DataFrame:
    """FLT-09: words with ``count >= threshold`` (reserved entries always kept)."""
    return vocab.filter((F.col("count") >= threshold) | F.col("symbol").isin(SPECIAL_SYMBOLS))


def vocab_intersect(a: DataFrame, b: DataFrame, col: str = "symbol") -> DataFrame:
    """SET-03: symbols present in both (e.g. embedding words ∩ vocabulary)."""
    return a.select(col).intersect(b.select(col))


def vocab_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-04: one row ``equal`` = both symbol→id maps hold exactly the same pairs."""
    x = a.select("symbol", "id")
    y = b.select("symbol", "id")
    diff = x.exceptAll(y).unionByName(y.exceptAll(x))
    return diff.agg((F.count(F.lit(1)) == 0).alias("equal"))


def oov_types(tokens: DataFrame, vocab: DataFrame, group_cols: list[str]) -> DataFrame:
    """JN-13: word types that would be replaced by unk, with their occurrence counts per group.

    Pre-aggregates (group, symbol) before the anti join so a hot word is one row per task.
    """
    per_type = tokens.groupBy(*group_cols, "symbol").agg(F.count(F.lit(1)).alias("n"))
    known = vocab.select("symbol")
    return (per_type.join(maybe_broadcast(known), "symbol", "left_anti")
            .filter(F.col("symbol") != UNK_WORD))


__all__ = [
    "VOCAB_SCHEMA", "explode_tokens", "count_words", "finalize_vocab", "build_vocab", "merge_vocab",
    "top_n_words", "min_count_threshold", "vocab_intersect", "vocab_equal", "oov_types", "UNK",
]

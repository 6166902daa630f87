"""Encoding and decoding against a vocabulary: PRJ-02..06, JN-01, JN-02, AGG-05.

Two physical strategies for the token → id lookup (JN-01):

* ``broadcast`` (default when the vocabulary's row count is proven under a bound): the vocabulary
  is shipped once per executor and every Arrow batch is looked up column-wise with
  ``pyarrow.compute.index_in`` — no shuffle at all, work grows with tokens only.
* ``shuffle``: tokens are exploded, joined to the vocabulary with a plain equi-join (sort-merge,
  AQE splits hot words) and regrouped per line in token order.  Without columns that name a line, lines are dealt to blocks of
  bounded text instead; a block asks the vocabulary once for each of its words, and its lines meet the answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcorpus.constants import EOS, UNK, UNK_ESCAPED, UNK_WORD
from seqcorpus.functions.text import arrow_words, tokenize
from seqcorpus.plans.broadcast import DEFAULT_MAX_BROADCAST_BYTES, DEFAULT_MAX_BROADCAST_ROWS, maybe_broadcast, size_of, stored


#: Bytes of words in a block of lines that is encoded against its own part of a large vocabulary.
BLOCK_BYTES = 8 << 20


def _within(vocab: DataFrame, max_rows: int):
    """The (symbol, id) columns of a vocabulary within both broadcast bounds as an Arrow table, else None.  Its plan runs once."""
    held = stored(vocab.select("symbol", "id"))
    rows, size = size_of(held)
    return held.toArrow().combine_chunks() if rows <= max_rows and size <= DEFAULT_MAX_BROADCAST_BYTES else None


def _list_parts(arr):
    """(offsets starting at 0 as numpy, flat values) of an Arrow list array, slice-safe."""
    import numpy as np
    import pyarrow as pa

    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = np.asarray(arr.offsets, dtype=np.int64)
    off = off - off[0]
    return arr, off, arr.flatten()


#: Entries of a lookup table from which batches are looked up together, since its hash table is made anew each time; and their bytes.
LARGE_TABLE, HELD_BYTES = 200_000, 32 << 20


def _arrow_encoder(symbols, ids, tokens_col, out_col, append_eos, reverse, eos, unk):
    def joined(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > HELD_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        value_set = symbols.combine_chunks() if isinstance(symbols, pa.ChunkedArray) else symbols
        id_np = np.asarray(ids)
        for batch in joined(batches) if len(value_set) > LARGE_TABLE else batches:
            toks = batch.column(batch.schema.get_field_index(tokens_col))
            if pa.types.is_string(toks.type):
                off, flat = arrow_words(toks)
            else:
                toks, off, flat = _list_parts(toks)
            pos = pc.fill_null(pc.index_in(flat, value_set=value_set), -1).to_numpy(zero_copy_only=False)
            vals = np.where(pos >= 0, id_np[np.maximum(pos, 0)] if len(id_np) else unk, unk).astype(id_np.dtype)
            n = len(off) - 1
            if reverse and len(vals):
                starts = off[:-1]
                ends = off[1:]
                row = np.repeat(np.arange(n), ends - starts)
                k = np.arange(len(vals))
                vals = vals[starts[row] + ends[row] - 1 - k]
            if append_eos:
                new_off = off + np.arange(n + 1)
                out = np.empty(len(vals) + n, dtype=vals.dtype)
                mask = np.ones(len(out), dtype=bool)
                mask[new_off[1:] - 1] = False
                out[mask] = vals
                out[~mask] = eos
                vals, off = out, new_off
            lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(vals),
                                             mask=toks.is_null() if toks.null_count else None)
            cols = [batch.column(i) for i in range(batch.num_columns)] + [lists]
            yield pa.RecordBatch.from_arrays(cols, names=list(batch.schema.names) + [out_col])
    return run


def encode_tokens(df: DataFrame, vocab: DataFrame, tokens_col: str = "tokens", out_col: str = "ids",
                  append_eos: bool = True, reverse_order: bool = False, how: str = "auto",
                  key_cols: list[str] | None = None,
                  max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """PRJ-02/03/04 + JN-01: ``tokens ARRAY<STRING>`` → ``ids ARRAY<INT>``; unknown → 3;
    optional reversal, then optional end-of-sentence id.  An empty line encodes to ``[2]``."""
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(T.IntegerType()))])
    known = None if how == "shuffle" else _within(vocab, max_broadcast_rows)
    if known is None and how == "broadcast":
        raise ValueError("vocabulary too large to broadcast")
    if known is not None:
        symbols, ids = known.column("symbol"), known.column("id").to_numpy()
        return df.mapInArrow(_arrow_encoder(symbols, ids, tokens_col, out_col, append_eos, reverse_order, EOS, UNK),
                             out_schema)
    if not key_cols:
        return _looked_up_in_blocks(df, vocab, tokens_col, out_col, append_eos, reverse_order, UNK, out_schema)
    exploded = df.select(*key_cols, F.posexplode(F.col(tokens_col)).alias("_pos", "symbol"))
    looked = (exploded.join(vocab.select("symbol", "id"), "symbol", "left")
              .select(*key_cols, "_pos", F.coalesce(F.col("id"), F.lit(UNK)).alias("_id")))
    regrouped = looked.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda x: x["_id"]).alias("_ids"))
    out = df.join(regrouped, key_cols, "left")
    ids = F.coalesce(F.col("_ids"), F.array().cast("array<int>"))
    if reverse_order:
        ids = F.reverse(ids)
    if append_eos:
        ids = F.concat(ids, F.array(F.lit(EOS)))
    return out.withColumn(out_col, ids).drop("_ids")


def looked_up(df: DataFrame, table: DataFrame, words_col: str, out_col: str, default, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with the array ``out_col`` of the values that the table ``(symbol, id)`` has for the words in ``words_col``, or ``default``."""
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.ArrayType(table.schema["id"].dataType))])
    known = _within(table, max_broadcast_rows)
    if known is None:
        return _looked_up_in_blocks(df, table, words_col, out_col, False, False, default, out_schema)
    return df.mapInArrow(_arrow_encoder(known.column("symbol"), known.column("id").to_numpy(), words_col, out_col, False, False, EOS, default), out_schema)


def _looked_up_in_blocks(df, vocab, tokens_col, out_col, append_eos, reverse, unk, out_schema) -> DataFrame:
    """Rows dealt by a hash of all their columns to blocks of about ``BLOCK_BYTES`` of words.  A block's different words meet the
    vocabulary, and what is found comes back to the block: no token is shuffled, and no task holds more than a block's words."""
    text = isinstance(df.schema[tokens_col].dataType, T.StringType)
    words = tokenize(tokens_col) if text else F.col(tokens_col)
    n_bytes = F.octet_length(tokens_col) if text else F.size(tokens_col) * 8
    blocks = max(1, -(-(df.agg(F.sum(n_bytes)).first()[0] or 0) // BLOCK_BYTES))  # one scalar
    hashed = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    placed = df.withColumn("_block", F.pmod(F.xxhash64(*hashed), F.lit(blocks))).repartition(blocks, "_block")
    asked = placed.select("_block", F.explode(words).alias("symbol")).distinct()
    found = asked.join(vocab.select("symbol", "id"), "symbol").select(F.col("_block").alias("_of"), "symbol", "id")

    def run(lines, answers):
        import pyarrow as pa

        encoder = _arrow_encoder(answers.column("symbol"), answers.column("id").to_numpy(), tokens_col, out_col, append_eos, reverse, EOS, unk)
        made = [*encoder(lines.drop_columns(["_block"]).to_batches())]
        return pa.Table.from_batches(made)

    return placed.groupBy("_block").cogroup(found.groupBy("_of")).applyInArrow(run, out_schema)


def encode_lines(lines: DataFrame, vocab: DataFrame, text_col: str = "text", out_col: str = "ids",
                 tokenizer: Callable = tokenize, **kw) -> DataFrame:
    """Tokenise (PRJ-01, or the given function of a column to an array of words; a pandas UDF is one) then encode.  PRJ-01 is done
    inside the Arrow batches that are encoded."""
    if tokenizer is tokenize and not kw.get("key_cols"):
        return encode_tokens(lines, vocab, text_col, out_col, **kw).withColumn("_tokens", tokenize(text_col))
    return encode_tokens(lines.withColumn("_tokens", tokenizer(F.col(text_col))), vocab, "_tokens", out_col, **kw)


def encode_stats(lines: DataFrame, vocab: DataFrame, group_cols: list[str], text_col: str = "text",
                 append_eos: bool = True, max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS, tokenizer: Callable = tokenize) -> DataFrame:
    """AGG-05 (+JN-13): per group ``nseq, ntok, nunk, replaced, pct_replaced``.

    ``nunk`` counts occurrences of words missing from the vocabulary (a literal ``<unk>`` is not
    counted), ``replaced`` the distinct such words.  Tokens are pre-aggregated per
    (group, word) map-side before the anti join, so a hot word costs one row per task.
    """
    # one pass: each line explodes its tokens plus one null marker (counts the line); the
    # (group, word) pre-aggregation collapses hot words map-side before the anti join
    marked = F.concat(tokenizer(F.col(text_col)).cast("array<string>"), F.array(F.lit(None).cast("string")))
    words = (lines.select(*group_cols, F.explode(marked).alias("symbol"))
             .groupBy(*group_cols, "symbol").agg(F.count(F.lit(1)).alias("n")))
    line_stats = words.groupBy(*group_cols).agg(
        F.sum(F.when(F.col("symbol").isNull(), F.col("n"))).cast("long").alias("nseq"),
        F.sum(F.col("n") if append_eos else F.when(F.col("symbol").isNotNull(), F.col("n"))).cast("long").alias("ntok"))
    known = maybe_broadcast(vocab.select("symbol"), max_broadcast_rows)
    unknown = (words.filter(F.col("symbol").isNotNull()).join(known, "symbol", "left_anti")
               .filter(F.col("symbol") != UNK_WORD))
    unk_stats = unknown.groupBy(*group_cols).agg(F.sum("n").cast("long").alias("nunk"),
                                                 F.count(F.lit(1)).alias("replaced"))
    out = line_stats.join(unk_stats, group_cols, "left")
    return out.select(
        *group_cols, "nseq", "ntok",
        F.coalesce(F.col("nunk"), F.lit(0)).cast("long").alias("nunk"),
        F.coalesce(F.col("replaced"), F.lit(0)).cast("long").alias("replaced"),
        F.round(100.0 * F.coalesce(F.col("nunk"), F.lit(0)) / F.col("ntok"), 6).alias("pct_replaced"))


def decode(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", out_col: str = "text",
           escape_unk: bool = False, bpe_symbol: str | None = None,
           max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """PRJ-05/06/07 + JN-02: drop every end-of-sentence id, map id → symbol (out of range →
    ``<unk>``; the unk id → ``<<unk>>`` when escaping), join by spaces, optionally remove BPE.
    Pads are kept.  Vectorised lookup against the broadcast vocabulary."""
    rows = _within(vocab, max_broadcast_rows)
    if rows is None:
        raise ValueError("vocabulary too large to broadcast for decode")
    rows = list(zip(rows.column("symbol").to_pylist(), rows.column("id").to_pylist()))
    size = max(r[1] for r in rows) + 1
    table = [UNK_WORD] * size
    for s, i in rows:
        table[i] = s
    if escape_unk:
        table[UNK] = UNK_ESCAPED
    out_schema = T.StructType(df.schema.fields + [T.StructField(out_col, T.StringType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sym = pa.array(table, pa.string())
        for batch in batches:
            arr = batch.column(batch.schema.get_field_index(ids_col))
            if isinstance(arr, pa.ChunkedArray):
                arr = arr.combine_chunks()
            parents = pc.list_parent_indices(arr)
            flat = arr.flatten()
            keep = pc.not_equal(flat, EOS)
            flat = pc.filter(flat, keep)
            parents = pc.filter(parents, keep)
            in_range = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, size))
            idx = pc.if_else(in_range, flat, pa.scalar(UNK, flat.type))
            words = pc.take(sym, idx)
            words = pc.if_else(in_range, words, pa.scalar(UNK_WORD))
            n = len(arr)
            lens = np.bincount(parents.to_numpy(zero_copy_only=False).astype(np.int64), minlength=n)
            offs = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offs), words)
            texts = pc.binary_join(lists, " ")
            texts = pc.if_else(pc.is_null(arr), pa.scalar(None, pa.string()), texts)
            if bpe_symbol is not None:
                texts = pc.utf8_rtrim(pc.replace_substring(pc.binary_join_element_wise(texts, "", " "),
                                                           bpe_symbol, ""), characters=" ")
            cols = [batch.column(i) for i in range(batch.num_columns)] + [texts]
            yield pa.RecordBatch.from_arrays(cols, names=list(batch.schema.names) + [out_col])

    return df.mapInArrow(run, out_schema)

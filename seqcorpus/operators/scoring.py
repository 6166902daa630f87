"""Scoring and losses on probability tables: JN-09, AGG-14..19, AGG-21, AGG-27, WIN-02, WIN-03,
WIN-10, WIN-11, FLT-06, FLT-07.

A model is a table ``(ctx, token, lp)`` of natural-log probabilities for the observed pairs plus
``(ctx, lp0, n_seen)`` for the probability of every unobserved token in a context, so full-
vocabulary sums (label smoothing, KL) are closed forms per context instead of V rows per
position.  Positions are ``(key..., pos, ctx, token)``; every join is an equi-join on (ctx, token)
or ctx, with the model side broadcast only when its size is proven small.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcorpus.constants import EOS, PAD
from seqcorpus.operators import bigrams
from seqcorpus.plans.broadcast import maybe_broadcast, stored

LN2 = math.log(2)


def positions(df: DataFrame, key_cols: list[str], ids_col: str = "ids", nested: bool = False) -> DataFrame:
    """Gold positions with the previous token as context (decoder input starts with eos).  ``nested``: ``(keys, tokens)``, all positions
    of a row in one array."""
    if nested:
        return df.select(*key_cols, F.col(ids_col).alias("tokens"))
    prev = F.concat(F.array(F.lit(EOS)), F.slice(ids_col, 1, F.size(ids_col) - 1))
    z = F.arrays_zip(prev.alias("ctx"), F.col(ids_col).alias("token"))
    return df.select(*key_cols, F.posexplode(z).alias("pos", "_z")).select(
        *key_cols, F.col("pos").cast("int").alias("pos"), F.col("_z.ctx").alias("ctx"), F.col("_z.token").alias("token"))


def bigram_model(pos: DataFrame, vocab_size: int, k: float = 1.0):
    """Add-k bigram model from positions: ``(ctx, token, lp)`` observed and ``(ctx, lp0, n_seen)``.
    One aggregation on (ctx, token) (partial aggregation first), written once for all its uses, and one on ctx.  Nested
    positions are counted on Arrow batches."""
    pairs = stored(bigrams.pair_counts(pos, "tokens") if "tokens" in pos.columns else pos.groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("c")))
    ctx = pairs.groupBy("ctx").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("n_seen"))
    denom = F.col("t") + F.lit(k * vocab_size)
    model = pairs.join(ctx, "ctx").select("ctx", "token", F.log((F.col("c") + k) / denom).alias("lp"))
    unseen = ctx.select("ctx", F.log(F.lit(k) / denom).alias("lp0"), "n_seen")
    return model, unseen


def label_gather(pos: DataFrame, model: DataFrame, unseen: DataFrame) -> DataFrame:
    """JN-09: the log-probability of the gold token at every position.  Nested positions get an array ``lps``: the packed model goes to
    the rows, and nothing is shuffled, as long as a worker can hold it."""
    if "tokens" in pos.columns:
        parts = bigrams.packed(model, unseen)
        if parts is not None:
            return bigrams.gathered(pos, "tokens", parts)
        held = stored(pos.withColumn("_row", F.monotonically_increasing_id()))
        flat = label_gather(positions(held.where("size(tokens) > 0"), ["_row"], "tokens"), model, unseen)
        lps = flat.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lp"))), lambda x: x["lp"]).alias("lps"))
        return held.join(lps, "_row", "left").drop("_row").withColumn("lps", F.coalesce("lps", F.expr("CAST(array() AS ARRAY<DOUBLE>)")))
    j = (pos.join(maybe_broadcast(model), ["ctx", "token"], "left")
         .join(maybe_broadcast(unseen.select("ctx", "lp0")), "ctx", "left"))
    return j.withColumn("lp", F.coalesce("lp", "lp0")).drop("lp0")


def sequence_score(scored: DataFrame, key_cols: list[str], lenpen: float | None = 1.0,
                   normalize: bool = True) -> DataFrame:
    """AGG-14: sum of positional log-probs / len**lenpen (unnormalised = the sum)."""
    agg = scored.groupBy(*key_cols).agg(F.sum("lp").alias("_s"), F.count(F.lit(1)).alias("_n"))
    score = F.col("_s") / F.pow(F.col("_n"), F.lit(lenpen)) if normalize else F.col("_s")
    return agg.select(*key_cols, score.alias("score"), F.col("_n").alias("length"))


def drop_inf(scored: DataFrame, col: str = "lp"):
    """FLT-07: rows with finite scores, and the rows (tokens) that were removed."""
    finite = (F.col(col) != float("inf")) & (F.col(col) != float("-inf"))
    return scored.filter(finite), scored.filter(~finite)


def lm_perplexity(scored: DataFrame, group_cols: list[str] | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """AGG-15: ``nll = -sum / (n_scores - n_skipped)`` (natural log), ``ppl = exp(nll)``."""
    g = group_cols or []
    agg = scored.groupBy(*g).agg(F.sum("lp").alias("_s"), F.count(F.lit(1)).alias("_n"))
    if skipped is not None:
        sk = skipped.groupBy(*g).agg(F.count(F.lit(1)).alias("_k"))
        agg = agg.join(sk, g, "left") if g else agg.crossJoin(sk)
        agg = agg.withColumn("_n", F.col("_n") - F.coalesce("_k", F.lit(0)))
    nll = -F.col("_s") / F.col("_n")
    return agg.select(*g, F.col("_n").alias("count"), nll.alias("nll"), F.exp(nll).alias("ppl"))


def nll_loss(scored: DataFrame, group_cols: list[str], pad: int = PAD) -> DataFrame:
    """AGG-16 + FLT-06: -sum log p(gold) over non-pad positions; per token in bits."""
    s = scored.filter(F.col("token") != pad)
    agg = s.groupBy(*group_cols).agg((-F.sum("lp")).alias("loss"), F.count(F.lit(1)).alias("ntokens"))
    return agg.withColumn("loss_bits_per_token", F.col("loss") / F.col("ntokens") / F.lit(LN2))


def label_smoothed_loss(scored: DataFrame, unseen: DataFrame, model: DataFrame, vocab_size: int,
                        eps: float, group_cols: list[str], sentence_avg: bool = False, pad: int = PAD,
                        sentence_cols: list[str] | None = None) -> DataFrame:
    """AGG-17: ``(1-eps)*nll + eps/V * sum_v(-log p_v)`` per position, summed per group;
    ``loss / sample_size / ln 2`` and ``nll / ntokens / ln 2``.  The full-vocabulary sum per
    context = observed part + (V - n_seen) * (-lp0).  ``sentence_avg`` divides the loss by the number of
    sentences, told apart by ``sentence_cols``."""
    if sentence_avg and not sentence_cols:
        raise ValueError("sentence_avg needs the columns that name a sentence")
    sentence = F.struct(*sentence_cols) if sentence_cols else F.lit(None)
    ctx_sum = (model.groupBy("ctx").agg((-F.sum("lp")).alias("_obs"))
               .join(unseen, "ctx")
               .select("ctx", (F.col("_obs") - (F.lit(vocab_size) - F.col("n_seen")) * F.col("lp0")).alias("smooth")))
    s = scored.filter(F.col("token") != pad).join(maybe_broadcast(ctx_sum), "ctx", "left")
    per = s.select(*group_cols, "pos", sentence.alias("_sentence"), (-F.col("lp")).alias("nll"),
                   ((1 - eps) * (-F.col("lp")) + eps / vocab_size * F.col("smooth")).alias("loss"))
    agg = per.groupBy(*group_cols).agg(F.sum("loss").alias("loss"), F.sum("nll").alias("nll"),
                                       F.count(F.lit(1)).alias("ntokens"),
                                       *([F.count_distinct("_sentence").alias("_n")] if sentence_avg else []))
    size = F.col("_n") if sentence_avg else F.col("ntokens")
    return agg.select(*group_cols, "loss", "nll", "ntokens",
                      (F.col("loss") / size / F.lit(LN2)).alias("loss_bits"),
                      (F.col("nll") / F.col("ntokens") / F.lit(LN2)).alias("nll_bits"))


def argmax_token(model: DataFrame) -> DataFrame:
    """Most probable token per context, ties to the smaller id."""
    return model.groupBy("ctx").agg(F.max_by("token", F.struct("lp", -F.col("token"))).alias("pred"))


def token_accuracy(scored: DataFrame, model: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """AGG-18: share of positions whose argmax token equals the gold token, in percent."""
    g = group_cols or []
    j = scored.join(maybe_broadcast(argmax_token(model)), "ctx", "left")
    return j.groupBy(*g).agg(F.sum(F.when(F.col("pred") == F.col("token"), 1).otherwise(0)).alias("correct"),
                             F.count(F.lit(1)).alias("ntokens")).withColumn(
        "accuracy", F.col("correct") * 100.0 / F.col("ntokens"))


def kl_teaching(student: tuple, teacher: tuple, vocab_size: int) -> DataFrame:
    """AGG-19: per context ``sum_v t_v (ln t_v - lp_v)`` over the full vocabulary (teacher prob 0
    contributes 0).  Closed form: observed tokens of either model + the unobserved remainder."""
    sm, su = student
    tm, tu = teacher
    both = (tm.select("ctx", "token", F.col("lp").alias("tlp"))
            .join(sm.select("ctx", "token", F.col("lp").alias("slp")), ["ctx", "token"], "full_outer")
            .join(tu.select("ctx", F.col("lp0").alias("t0")), "ctx")
            .join(su.select("ctx", F.col("lp0").alias("s0")), "ctx"))
    t = F.coalesce("tlp", "t0")
    s = F.coalesce("slp", "s0")
    term = F.when(F.exp(t) > 0, F.exp(t) * (t - s)).otherwise(0.0)
    obs = both.groupBy("ctx").agg(F.sum(term).alias("_obs"), F.count(F.lit(1)).alias("_n"),
                                  F.first("t0").alias("t0"), F.first("s0").alias("s0"))
    rest = (F.lit(vocab_size) - F.col("_n")) * F.when(F.exp("t0") > 0, F.exp("t0") * (F.col("t0") - F.col("s0"))).otherwise(0.0)
    return obs.select("ctx", (F.col("_obs") + rest).alias("kl"))


def ensemble_average(models: list[DataFrame], n_models: int | None = None) -> DataFrame:
    """AGG-27: mean of probabilities over models (a model without the row counts 0), then log.
    One model passes through unchanged."""
    if len(models) == 1:
        return models[0]
    n = n_models or len(models)
    u = models[0].select("ctx", "token", "lp")
    for m in models[1:]:
        u = u.unionByName(m.select("ctx", "token", "lp"))
    return u.groupBy("ctx", "token").agg(F.log(F.sum(F.exp("lp")) / n).alias("lp"))


def cumulative_to_positional(df: DataFrame, key_cols: list[str], pos_col: str = "pos", cum_col: str = "cum") -> DataFrame:
    """WIN-02: ``s_t - s_{t-1}``, the first unchanged (window per hypothesis, bounded by its length)."""
    w = Window.partitionBy(*key_cols).orderBy(pos_col)
    return df.withColumn("positional", F.col(cum_col) - F.coalesce(F.lag(cum_col).over(w), F.lit(0.0)))


def nbest(hyps: DataFrame, key_cols: list[str], n: int, score_col: str = "score", tie_cols: list[str] | None = None) -> DataFrame:
    """WIN-03: hypotheses by score desc per sample, keep the first n (rank filter pushed below the
    window as a group limit)."""
    w = Window.partitionBy(*key_cols).orderBy(F.col(score_col).desc(), *[F.col(c) for c in (tie_cols or [])])
    return hyps.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _merger(n_keys: int, marker: str):
    """Arrow batches of (keys, pieces, scores) -> (keys, word_no, word, score, n_merged), a row a word."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            lists, scores = batch.column(n_keys), batch.column(n_keys + 1).flatten().to_numpy(zero_copy_only=False)
            at, flat = np.asarray(lists.offsets, dtype=np.int64), lists.flatten()
            at = at - at[0]
            if not len(flat):
                continue
            cont = pc.ends_with(flat, marker).to_numpy(zero_copy_only=False)
            cont[at[1:][at[1:] > at[:-1]] - 1] = False  # the last piece of a hypothesis
            bare = pc.if_else(pa.array(cont), pc.utf8_slice_codeunits(flat, 0, -len(marker)), flat)
            first = np.flatnonzero(np.concatenate([[True], ~cont[:-1]]))
            row = np.searchsorted(at, first, side="right") - 1
            word_no = np.arange(len(first)) - np.searchsorted(first, at[row])
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), bare), "")
            place = pa.array(row)
            made = [*[batch.column(c).take(place) for c in range(n_keys)], pa.array(word_no), words,
                    pa.array(np.add.reduceat(scores, first)), pa.array(np.add.reduceat(cont.astype(np.int64), first))]
            out = pa.Table.from_arrays(made, names=[*batch.schema.names[:n_keys], "word_no", "word", "score", "n_merged"])
            yield from out.to_batches(1 << 16)
    return run


def merge_bpe_scores(pieces: DataFrame, key_cols: list[str], marker: str = "@@", pos_col: str = "pos",
                     piece_col: str = "piece", score_col: str = "score") -> DataFrame:
    """WIN-10: a piece ending in the marker adds its score to the next piece (the last piece
    is never merged); words are rebuilt from pieces with their summed score.

    Word id = number of word ends strictly before the piece (running count per hypothesis).  Rows may hold a whole hypothesis
    each, with arrays of pieces and scores: then the keys must be unique, and nothing is shuffled."""
    if isinstance(pieces.schema[piece_col].dataType, T.ArrayType):
        rows = pieces.select(*key_cols, piece_col, score_col)
        keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:len(key_cols)])
        return rows.mapInArrow(_merger(len(key_cols), marker), f"{keys}word_no long, word string, score double, n_merged long")
    w = Window.partitionBy(*key_cols).orderBy(pos_col)
    last = F.lead(pos_col).over(w).isNull()
    cont = F.col(piece_col).endswith(marker) & ~last
    p = pieces.withColumn("_cont", cont).withColumn("_bare", F.when(cont, F.expr(f"substring({piece_col}, 1, length({piece_col}) - {len(marker)})")).otherwise(F.col(piece_col)))
    p = p.withColumn("word_no", F.coalesce(F.sum(F.when(F.col("_cont"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    made = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("pos"), F.col("_bare").alias("piece")))), lambda x: x["piece"])
    return p.groupBy(*key_cols, "word_no").agg(F.array_join(made, "").alias("word"), F.sum(score_col).alias("score"),
                                               F.sum(F.col("_cont").cast("int")).alias("n_merged"))


def word_probs(pieces: DataFrame, key_cols: list[str], marker: str = "@@", pos_col: str = "pos",
               piece_col: str = "piece", score_col: str = "score") -> DataFrame:
    """WIN-11: ``(keys, word_no, word, score, n_pieces)``: the words of a hypothesis with their scores, aligned by position.  A word
    with an infinite piece is one that FLT-07 removes: its place stays, with a null score, so no later word moves up."""
    words = merge_bpe_scores(pieces, key_cols, marker, pos_col, piece_col, score_col)
    finite = F.abs(F.col("score")) < float("inf")
    return words.select(*key_cols, "word_no", "word", F.when(finite, F.col("score")).alias("score"), (F.col("n_merged") + 1).alias("n_pieces"))


def post_process(hyps: DataFrame, key_cols: list[str], vocab: DataFrame, lexicon: DataFrame | None = None, ids_col: str = "ids",
                 src_tokens: str = "src_tokens", alignment: str = "alignment", bpe_symbol: str | None = None) -> DataFrame:
    """SCR-06: ``(keys, text, tokens)`` of hypotheses as they go into BLEU: ids become text, subwords are joined again where there is a
    ``bpe_symbol``, unknown words are replaced by the lexicon's word for the aligned source word, or by that word itself, and the
    text is split into words anew.  Words are compared as strings, so no vocabulary has to grow."""
    from seqcorpus.functions.text import remove_bpe, tokenize
    from seqcorpus.operators.align import replace_unk
    from seqcorpus.operators.encode import decode

    text = decode(hyps.select(*key_cols, ids_col, *([src_tokens, alignment] if lexicon is not None else [])), vocab, ids_col, "_text")
    joined = remove_bpe("_text", bpe_symbol) if bpe_symbol else F.col("_text")
    text = text.withColumn("text", joined)
    if lexicon is not None:
        words = text.withColumn("_words", tokenize("text"))
        text = replace_unk(words, key_cols, "_words", src_tokens, alignment, lexicon)
        text = hyps.select(*key_cols).join(text, key_cols, "left").withColumn("text", F.coalesce("text", F.lit("")))
    return text.select(*key_cols, "text", tokenize("text").alias("tokens"))

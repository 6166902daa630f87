"""Registered queries: every operator bound to the driver's tables (whole tables, no row caps).

Each entry is ``name -> callable(spark, sf_dir) -> DataFrame``; names start with the lower-cased
operator id of the inventory.  Output columns are named exactly as in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcorpus.functions.text import tokenize
from seqcorpus.operators import encode as enc
from seqcorpus.operators import vocab as voc
from seqcorpus.plans.broadcast import stored
from seqcorpus.sources.tables import by_key, conversation_pairs, document_lines, table, text_tasks

# --- fixed parameters of the registered queries ------------------------------------------
VOCAB_THRESHOLD = 2
VOCAB_NWORDS = 30000
LINE_ORDER = ["doc_id", "line_no"]

REGISTRY: dict = {}


def register(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def doc_vocab(spark, sf_dir, threshold=VOCAB_THRESHOLD, nwords=VOCAB_NWORDS):
    lines = document_lines(spark, sf_dir, cols=())
    return voc.build_vocab(lines, LINE_ORDER, threshold=threshold, nwords=nwords)


@register("agg_05_encode_stats")
def q_encode_stats(spark, sf_dir):
    """Flagship: per-language sentence, token, unknown-occurrence and replaced-type counts."""
    lines = document_lines(spark, sf_dir)
    vocab = doc_vocab(spark, sf_dir)
    return enc.encode_stats(lines, vocab, ["lang"])


# ----------------------------------------------------------------------------------------
# corpus and vocabulary (documents broken into lines)
# ----------------------------------------------------------------------------------------
def _first_cols():
    return [F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"),
            F.col("first.pos").cast("long").alias("first_pos")]


@register("src_01_read_lines")
def q_read_lines(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    return lines.select("doc_id", "line_no", "lang", "text")


@register("prj_01_tokenize_line")
def q_tokenize(spark, sf_dir):
    lines = document_lines(spark, sf_dir, cols=())
    t = tokenize("text")
    return lines.select("doc_id", "line_no", F.size(t).cast("long").alias("n_tokens"),
                        F.array_join(t, " ").alias("tokens"))


@register("agg_01_count_words")
def q_count_words(spark, sf_dir):
    lines = document_lines(spark, sf_dir, cols=())
    c = voc.count_words(lines, LINE_ORDER)
    return c.select("symbol", "count", *_first_cols())


@register("agg_04_finalize_vocab")
def q_finalize_vocab(spark, sf_dir):
    return doc_vocab(spark, sf_dir)


@register("win_01_rank_to_id")
def q_rank_to_id(spark, sf_dir):
    """Unbounded vocabulary (no nwords): ids from the distributed global index."""
    return doc_vocab(spark, sf_dir, threshold=2, nwords=-1)


@register("srt_05_top_n_words")
def q_top_n(spark, sf_dir):
    lines = document_lines(spark, sf_dir, cols=())
    return voc.top_n_words(voc.count_words(lines, LINE_ORDER), 100)


@register("flt_09_min_count_threshold")
def q_min_count(spark, sf_dir):
    return voc.min_count_threshold(doc_vocab(spark, sf_dir, threshold=-1, nwords=-1), 5)


def _lang_vocab(spark, sf_dir, lang_pred, threshold=-1, nwords=-1, padding=8):
    lines = document_lines(spark, sf_dir).filter(lang_pred)
    return voc.build_vocab(lines, LINE_ORDER, threshold=threshold, nwords=nwords, padding_factor=padding)


@register("agg_02_merge_vocab")
def q_merge_vocab(spark, sf_dir):
    left = _lang_vocab(spark, sf_dir, F.col("lang") == "en", threshold=3)
    right = _lang_vocab(spark, sf_dir, F.col("lang") == "fr", threshold=3)
    return voc.merge_vocab(left, right)


@register("set_03_vocab_intersect")
def q_vocab_intersect(spark, sf_dir):
    a = _lang_vocab(spark, sf_dir, F.col("lang") == "en")
    b = _lang_vocab(spark, sf_dir, F.col("lang") == "de")
    return voc.vocab_intersect(a, b)


@register("set_04_vocab_equal")
def q_vocab_equal(spark, sf_dir):
    """The bounded (top-n) and the unbounded (global index) ranking agree when nwords is large."""
    a = doc_vocab(spark, sf_dir, threshold=3, nwords=10_000_000)
    b = doc_vocab(spark, sf_dir, threshold=3, nwords=-1)
    return voc.vocab_equal(a, b)


@register("agg_03_joined_vocab")
def q_joined_vocab(spark, sf_dir):
    """One vocabulary over source and target sides, first-seen order source side first."""
    pairs = conversation_pairs(spark, sf_dir)
    src = pairs.select(F.lit(0).alias("side"), "conv_id", "turn", F.col("src_text").alias("text"))
    tgt = pairs.select(F.lit(1).alias("side"), "conv_id", "turn", F.col("tgt_text").alias("text"))
    return voc.build_vocab(src.unionByName(tgt), ["side", "conv_id", "turn"], threshold=2, nwords=-1)


# ----------------------------------------------------------------------------------------
# encode / decode
# ----------------------------------------------------------------------------------------
def _encoded(spark, sf_dir, **kw):
    lines = document_lines(spark, sf_dir, cols=())
    return enc.encode_lines(lines, doc_vocab(spark, sf_dir), **kw)


def _ids_str(col):
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), " ")


@register("jn_01_encode")
def q_encode(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", "line_no", F.size("ids").cast("long").alias("n_ids"), _ids_str("ids").alias("ids"))


@register("prj_03_reverse_order")
def q_encode_reversed(spark, sf_dir):
    e = _encoded(spark, sf_dir, reverse_order=True)
    return e.select("doc_id", "line_no", _ids_str("ids").alias("ids"))


@register("prj_04_append_eos_off")
def q_encode_no_eos(spark, sf_dir):
    e = _encoded(spark, sf_dir, append_eos=False)
    return e.select("doc_id", "line_no", _ids_str("ids").alias("ids"))


@register("prj_02_encode_shuffle_join")
def q_encode_shuffle(spark, sf_dir):
    """Same ids as jn_01 through the shuffle strategy (the path for vocabularies too large to ship)."""
    e = _encoded(spark, sf_dir, how="shuffle", key_cols=["doc_id", "line_no"])
    return e.select("doc_id", "line_no", F.size("ids").cast("long").alias("n_ids"), _ids_str("ids").alias("ids"))


@register("jn_13_oov_types")
def q_oov(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    toks = voc.explode_tokens(lines, LINE_ORDER, keep=["lang"])
    return voc.oov_types(toks, doc_vocab(spark, sf_dir), ["lang"]).select("lang", "symbol", F.col("n").cast("long"))


@register("prj_05_decode")
def q_decode(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    e = enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab)
    return enc.decode(e.select("doc_id", "line_no", "ids"), vocab).select("doc_id", "line_no", "text")


@register("prj_06_escape_unk")
def q_decode_escaped(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    e = enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab)
    return enc.decode(e.select("doc_id", "line_no", "ids"), vocab, escape_unk=True).select("doc_id", "line_no", "text")


@register("jn_02_id_to_symbol")
def q_id_to_symbol(spark, sf_dir):
    """Long form: every encoded position with its symbol (left join, default '<unk>')."""
    vocab = doc_vocab(spark, sf_dir)
    e = enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab)
    ex = e.select("doc_id", "line_no", F.posexplode("ids").alias("pos", "id"))
    from seqcorpus.plans.broadcast import maybe_broadcast
    return (ex.join(maybe_broadcast(vocab.select("id", "symbol")), "id", "left")
            .select("doc_id", "line_no", F.col("pos").cast("long").alias("pos"), "id",
                    F.coalesce("symbol", F.lit("<unk>")).alias("symbol")))


# ----------------------------------------------------------------------------------------
# BLEU / ROUGE on conversation pairs: reference = turn t, hypothesis = turn t+1
# ----------------------------------------------------------------------------------------
from seqcorpus.operators import bleu as bl  # noqa: E402

PAIR_KEY = ["conv_id", "turn"]


def _pair_tokens(spark, sf_dir):
    p = conversation_pairs(spark, sf_dir)
    return p.select(*PAIR_KEY, tokenize("src_text").alias("ref"), tokenize("tgt_text").alias("hyp"))


def _pair_stats(spark, sf_dir):
    return bl.bleu_stats(_pair_tokens(spark, sf_dir), PAIR_KEY, "ref", "hyp")


@register("agg_08_bleu_stats")
def q_bleu_stats(spark, sf_dir):
    return _pair_stats(spark, sf_dir)


@register("jn_08_ngram_clip_match")
def q_clip(spark, sf_dir):
    p = _pair_tokens(spark, sf_dir)
    return bl.clipped_matches(p, PAIR_KEY, "ref", "hyp").select(*PAIR_KEY, F.col("n").cast("int"), "match")


@register("agg_09_corpus_bleu")
def q_corpus_bleu(spark, sf_dir):
    return bl.corpus_bleu(_pair_stats(spark, sf_dir))


@register("agg_10_bleu_report")
def q_bleu_report(spark, sf_dir):
    return bl.bleu_report(bl.corpus_bleu(_pair_stats(spark, sf_dir)))


@register("agg_11_sentence_bleu")
def q_sentence_bleu(spark, sf_dir):
    return bl.sentence_bleu(_pair_stats(spark, sf_dir), PAIR_KEY)


@register("scr_07_select_checkpoint")
def q_select_checkpoint(spark, sf_dir):
    """Candidate systems = the role of the hypothesis turn; BLEU per system in one job, best by max_by."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    stats = _pair_stats(spark, sf_dir).join(
        conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("system")), PAIR_KEY)
    scores = bl.corpus_bleu(stats, ["system"])
    return scores.agg(F.max_by("system", F.struct("bleu", F.col("system"))).alias("best_system"),
                      F.max("bleu").alias("best_bleu"), F.count(F.lit(1)).alias("n_systems"))


@register("agg_12_multi_ref_bleu")
def q_multi_ref(spark, sf_dir):
    """Hypothesis = turn t+1; references = turns t and t+2 (lower-cased, max-count clipping)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    tasks = text_tasks(conv)
    turns = lambda shift: by_key(conv.select("conv_id", (F.col("turn") - shift).alias("turn"), "text"), PAIR_KEY, tasks)
    hyps = turns(1).select(*PAIR_KEY, tokenize("text").alias("hyp"))
    r0 = turns(0).select(*PAIR_KEY, F.lit(0).alias("ref_no"), tokenize("text").alias("ref"))
    r1 = turns(2).select(*PAIR_KEY, F.lit(1).alias("ref_no"), tokenize("text").alias("ref"))
    refs = r0.unionByName(r1).join(hyps.select(*PAIR_KEY), PAIR_KEY, "left_semi")
    hyps = hyps.join(r0.select(*PAIR_KEY), PAIR_KEY, "left_semi")
    stats = bl.multi_ref_bleu(hyps, refs, PAIR_KEY, "hyp", "ref", tasks=tasks)
    return bl.corpus_bleu(stats)


@register("agg_13_rouge_n")
def q_rouge_n(spark, sf_dir):
    p = _pair_tokens(spark, sf_dir)
    r1 = bl.rouge_n(p, PAIR_KEY, "ref", "hyp", 1).select(*PAIR_KEY, F.col("f1").alias("f1_1"))
    r2 = bl.rouge_n(p, PAIR_KEY, "ref", "hyp", 2).select(*PAIR_KEY, F.col("f1").alias("f1_2"))
    j = r1.join(r2, PAIR_KEY)
    return j.agg(F.round(F.avg("f1_1"), 6).alias("rouge1"), F.round(F.avg("f1_2"), 6).alias("rouge2"),
                 F.count(F.lit(1)).alias("n_pairs"))


@register("agg_13_rouge_l")
def q_rouge_l(spark, sf_dir):
    p = _pair_tokens(spark, sf_dir)
    r = bl.rouge_l(p, PAIR_KEY, "ref", "hyp")
    return r.select(*PAIR_KEY, F.col("lcs").cast("long").alias("lcs"), F.round("f1", 6).alias("f1"))


# ----------------------------------------------------------------------------------------
# parallel reads, length filters, ordering and batching (conversation pairs)
# ----------------------------------------------------------------------------------------
from seqcorpus.operators import batching as bt  # noqa: E402
from seqcorpus.sources import parallel as par  # noqa: E402

MAX_POSITIONS = 1024
MAX_TOKENS = 4500
BSZ_MULT = 8


def _turns(spark, sf_dir, shift=0):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return conv.select("conv_id", (F.col("turn") - shift).alias("turn"), "text")


@register("src_02_parallel_read")
def q_parallel_inner(spark, sf_dir):
    p = par.parallel_read(_turns(spark, sf_dir), _turns(spark, sf_dir, 1), PAIR_KEY, "inner")
    return p.select(*PAIR_KEY, F.length("src_text").cast("long").alias("src_chars"),
                    F.length("tgt_text").cast("long").alias("tgt_chars"))


@register("src_02_parallel_read_outer")
def q_parallel_outer(spark, sf_dir):
    p = par.parallel_read(_turns(spark, sf_dir), _turns(spark, sf_dir, 1), PAIR_KEY, "outer")
    return p.select(*PAIR_KEY, F.length("src_text").cast("long").alias("src_chars"),
                    F.length("tgt_text").cast("long").alias("tgt_chars"))


@register("src_03_multiway_read")
def q_multiway(spark, sf_dir):
    p = par.multiway_read(_turns(spark, sf_dir), _turns(spark, sf_dir, 1), PAIR_KEY,
                          pivot=_turns(spark, sf_dir, 2), train=False)
    return p.select(*PAIR_KEY, F.length("src_text").cast("long").alias("src_chars"),
                    F.length("tgt_text").cast("long").alias("tgt_chars"),
                    F.length("pivot_text").cast("long").alias("pivot_chars"))


@register("src_19_write_joined")
def q_write_joined(spark, sf_dir):
    p = par.parallel_read(_turns(spark, sf_dir), _turns(spark, sf_dir, 1), PAIR_KEY, "outer")
    return par.write_joined(p).select(*PAIR_KEY, F.md5("line").alias("line_md5"), F.length("line").cast("long").alias("n_chars"))


def _pair_lengths(spark, sf_dir):
    """(conv_id, turn, src_len, tgt_len): lengths include the end-of-sentence id."""
    p = conversation_pairs(spark, sf_dir)
    return p.select(*PAIR_KEY, (F.size(tokenize("src_text")) + 1).alias("src_len"),
                    (F.size(tokenize("tgt_text")) + 1).alias("tgt_len"))


def _batches(spark, sf_dir):
    rows = bt.valid_size(_pair_lengths(spark, sf_dir), MAX_POSITIONS, MAX_POSITIONS)
    return bt.token_budget_batches(rows, PAIR_KEY, MAX_TOKENS, None, BSZ_MULT)


@register("prj_23_num_tokens")
def q_num_tokens(spark, sf_dir):
    from seqcorpus.functions.arrays import num_tokens
    return _pair_lengths(spark, sf_dir).select(*PAIR_KEY, "src_len", "tgt_len",
                                               num_tokens("src_len", "tgt_len").alias("num_tokens"))


@register("flt_01_valid_size")
def q_valid_size(spark, sf_dir):
    from seqcorpus.functions.arrays import effective_max_positions
    cap = effective_max_positions(256, MAX_POSITIONS)  # PRJ-21: dataset cap vs model cap
    return bt.valid_size(_pair_lengths(spark, sf_dir), cap, cap)


@register("flt_02_invalid_report")
def q_invalid_report(spark, sf_dir):
    r = bt.invalid_report(_pair_lengths(spark, sf_dir), 128, 128, ["src_len", "tgt_len", "conv_id", "turn"],
                          "conv_id")
    return r.withColumnRenamed("_ids", "first_conv_ids")


@register("flt_03_clean_corpus")
def q_clean(spark, sf_dir):
    p = conversation_pairs(spark, sf_dir)
    w = p.select(*PAIR_KEY, tokenize("src_text").alias("s"), tokenize("tgt_text").alias("t"))
    return bt.clean_corpus(w, "s", "t", 1, 175, 1.5).select(*PAIR_KEY, F.size("s").cast("long").alias("src_words"),
                                                            F.size("t").cast("long").alias("tgt_words"))


@register("flt_04_modulo_split")
def q_modulo_split(spark, sf_dir):
    return bt.modulo_split(_pair_lengths(spark, sf_dir).select(*PAIR_KEY), PAIR_KEY, 23)


@register("srt_01_length_order")
def q_length_order(spark, sf_dir):
    return bt.length_order(_pair_lengths(spark, sf_dir), PAIR_KEY)


@register("bat_01_token_budget_batches")
def q_token_batches(spark, sf_dir):
    return _batches(spark, sf_dir).select(*PAIR_KEY, "batch_id", "pos_in_batch")


@register("agg_29_batch_ntokens")
def q_batch_ntokens(spark, sf_dir):
    return bt.batch_summary(_batches(spark, sf_dir))


@register("bat_06_maxlen_bound")
def q_maxlen(spark, sf_dir):
    return bt.maxlen_bound(bt.batch_summary(_batches(spark, sf_dir)), 1.2, 10).select("batch_id", "maxlen")


@register("bat_03_shard")
def q_shard(spark, sf_dir):
    return bt.shard(_batches(spark, sf_dir), 3)


@register("bat_04_accumulate")
def q_accumulate(spark, sf_dir):
    b = _batches(spark, sf_dir).select("batch_id").distinct()
    return bt.accumulate(b, [4, 2], epoch=1)


@register("srt_03_epoch_shuffle")
def q_epoch_shuffle(spark, sf_dir):
    b = _batches(spark, sf_dir).select("batch_id").distinct()
    return bt.epoch_shuffle(b, seed=1, epoch=3).select("batch_id", "epoch_ord")


@register("win_15_resume_position")
def q_resume(spark, sf_dir):
    b = bt.epoch_shuffle(_batches(spark, sf_dir).select("batch_id").distinct(), seed=1, epoch=3)
    return bt.resume_position(b, 5, epoch=3).select("batch_id", "epoch_ord", "epoch", "offset")


@register("srt_04_collate_order")
def q_collate_order(spark, sf_dir):
    b = _batches(spark, sf_dir)
    p = conversation_pairs(spark, sf_dir, bounded=False)
    vocab = voc.build_vocab(
        p.select(F.lit(0).alias("side"), *PAIR_KEY, F.col("src_text").alias("text"))
        .unionByName(p.select(F.lit(1).alias("side"), *PAIR_KEY, F.col("tgt_text").alias("text"))),
        ["side", "conv_id", "turn"], threshold=2)
    e = enc.encode_lines(p.select(*PAIR_KEY, F.col("src_text").alias("text")), vocab, out_col="src_ids").drop("text")
    e2 = enc.encode_lines(p.select(*PAIR_KEY, F.col("tgt_text").alias("text")), vocab, out_col="tgt_ids").drop("text")
    rows = b.join(e.drop("_tokens"), PAIR_KEY).join(e2.drop("_tokens"), PAIR_KEY)
    c = bt.collate(rows, id_cols=PAIR_KEY)
    return c.select(*PAIR_KEY, "batch_id", "row_in_batch", F.size("source").cast("long").alias("padded_src"),
                    F.size("target").cast("long").alias("padded_tgt"),
                    F.element_at("prev_output", 1).alias("first_prev"))


# ----------------------------------------------------------------------------------------
# token blocks: documents grouped by language as streams, lines in (doc_id, line_no) order
# ----------------------------------------------------------------------------------------
from seqcorpus.operators import blocks as blk  # noqa: E402

BLOCK_SIZE = 1024


def _stream_sentences(spark, sf_dir, with_ids=True):
    lines = document_lines(spark, sf_dir)
    if with_ids:
        e = enc.encode_lines(lines, doc_vocab(spark, sf_dir))
        return e.select("lang", "doc_id", "line_no", "ids")
    return lines.select("lang", "doc_id", "line_no", (F.size(tokenize("text")) + 1).alias("size"))


@register("win_06_token_blocks_none")
def q_blocks_none(spark, sf_dir):
    b = blk.blocks_none(_stream_sentences(spark, sf_dir), "lang", LINE_ORDER, BLOCK_SIZE)
    return b.select("lang", "block_id", "start_pos", "end_pos", F.md5(_ids_str("ids")).alias("ids_md5"))


@register("win_07_token_blocks_complete")
def q_blocks_complete(spark, sf_dir):
    s = blk.blocks_complete(_stream_sentences(spark, sf_dir, with_ids=False), "lang", LINE_ORDER, BLOCK_SIZE)
    return s.groupBy("lang", "block_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.sum("size").cast("long").alias("n_tokens"),
        F.min(F.struct("doc_id", "line_no")).alias("_f")).select(
        "lang", "block_id", "n_sentences", "n_tokens", F.col("_f.doc_id").alias("first_doc"),
        F.col("_f.line_no").alias("first_line"))


@register("win_08_token_blocks_eos")
def q_blocks_eos(spark, sf_dir):
    return blk.blocks_eos(_stream_sentences(spark, sf_dir, with_ids=False)).select(
        "lang", "doc_id", "line_no", F.col("size").cast("long").alias("size"))


@register("win_09_lm_shift")
def q_lm_shift(spark, sf_dir):
    b = blk.blocks_none(_stream_sentences(spark, sf_dir), "lang", LINE_ORDER, BLOCK_SIZE)
    s = blk.lm_shift(b, "lang")
    return s.select("lang", "block_id", F.md5(_ids_str("source")).alias("source_md5"),
                    F.md5(_ids_str("target")).alias("target_md5"))


@register("prj_17_first_n_words")
def q_first_n(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tokenize("text").alias("t"))
    f = F.slice("t", 1, 1000)
    return docs.select("doc_id", F.size(f).cast("long").alias("n_words"), F.md5(F.array_join(f, " ")).alias("words_md5"))


# ----------------------------------------------------------------------------------------
# scoring and losses: add-k bigram tables learned from the encoded document lines
# ----------------------------------------------------------------------------------------
from seqcorpus.functions.arrays import band_labels  # noqa: E402
from seqcorpus.operators import scoring as sc  # noqa: E402

R6 = 6


def _scored(spark, sf_dir, k=1.0, with_lang=False):
    vocab = doc_vocab(spark, sf_dir)
    V = vocab.count()
    lines = document_lines(spark, sf_dir, cols=("lang",) if with_lang else ())
    e = enc.encode_lines(lines, vocab)
    keys = ["doc_id", "line_no"] + (["lang"] if with_lang else [])
    pos = sc.positions(stored(e.select(*keys, "ids")), keys)  # the text is encoded once, for the model and for the scores
    model, unseen = sc.bigram_model(pos, V, k)
    return sc.label_gather(pos, model, unseen), model, unseen, V


@register("jn_09_label_gather")
def q_label_gather(spark, sf_dir):
    s, _, _, _ = _scored(spark, sf_dir)
    return s.select("doc_id", "line_no", "pos", "token", F.round("lp", R6).alias("lp"))


@register("agg_14_sequence_score")
def q_sequence_score(spark, sf_dir):
    s, _, _, _ = _scored(spark, sf_dir)
    r = sc.sequence_score(s, LINE_ORDER, lenpen=1.0)
    return r.select(*LINE_ORDER, F.round("score", R6).alias("score"), "length")


@register("win_03_nbest")
def q_nbest(spark, sf_dir):
    """Per document, its two best-scoring lines (length-normalised), ties by line number."""
    s, _, _, _ = _scored(spark, sf_dir)
    r = sc.sequence_score(s, LINE_ORDER, lenpen=1.0).withColumn("score", F.round("score", R6))
    return sc.nbest(r, ["doc_id"], 2, tie_cols=["line_no"]).select("doc_id", "line_no", "rank", "score")


@register("agg_15_lm_perplexity")
def q_perplexity(spark, sf_dir):
    s, _, _, _ = _scored(spark, sf_dir, with_lang=True)
    finite, dropped = sc.drop_inf(s)
    r = sc.lm_perplexity(finite, ["lang"])
    return r.select("lang", "count", F.round("nll", R6).alias("nll"), F.round("ppl", 4).alias("ppl"))


@register("agg_16_nll_loss")
def q_nll(spark, sf_dir):
    s, _, _, _ = _scored(spark, sf_dir, with_lang=True)
    r = sc.nll_loss(s, ["lang"])
    return r.select("lang", F.round("loss", 4).alias("loss"), "ntokens", F.round("loss_bits_per_token", R6).alias("bits"))


@register("agg_17_label_smoothed_loss")
def q_label_smoothed(spark, sf_dir):
    s, model, unseen, V = _scored(spark, sf_dir, with_lang=True)
    r = sc.label_smoothed_loss(s, unseen, model, V, 0.1, ["lang"])
    return r.select("lang", F.round("loss_bits", R6).alias("loss_bits"), F.round("nll_bits", R6).alias("nll_bits"), "ntokens")


@register("agg_18_token_accuracy")
def q_accuracy(spark, sf_dir):
    s, model, _, _ = _scored(spark, sf_dir, with_lang=True)
    r = sc.token_accuracy(s, model, ["lang"])
    return r.select("lang", "correct", "ntokens", F.round("accuracy", R6).alias("accuracy"))


@register("agg_21_banded_loss")
def q_banded(spark, sf_dir):
    s, _, _, V = _scored(spark, sf_dir)
    head, band, tail = band_labels(F.col("token"), [1000, 10000], V)
    r = s.select(band.alias("band"), head.alias("head"), tail.alias("tail"), "lp")
    return r.groupBy("band").agg(F.round(-F.sum("lp"), 4).alias("loss"), F.count(F.lit(1)).alias("ntokens"),
                                 F.min("head").alias("min_head"), F.max("tail").alias("max_tail"))


@register("agg_19_kl_teaching_loss")
def q_kl(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    V = vocab.count()
    e = enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab)
    pos = sc.positions(e.select(*LINE_ORDER, "ids"), LINE_ORDER)
    student = sc.bigram_model(pos, V, 1.0)
    teacher = sc.bigram_model(pos, V, 0.5)
    return sc.kl_teaching(student, teacher, V).select("ctx", F.round("kl", R6).alias("kl"))


@register("agg_27_ensemble_average")
def q_ensemble(spark, sf_dir):
    vocab = doc_vocab(spark, sf_dir)
    V = vocab.count()
    e = enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab)
    pos = sc.positions(e.select(*LINE_ORDER, "ids"), LINE_ORDER)
    models = [sc.bigram_model(pos, V, k)[0] for k in (0.5, 1.0, 2.0)]
    return sc.ensemble_average(models).select("ctx", "token", F.round("lp", R6).alias("lp"))


@register("win_02_cumulative_to_positional")
def q_cum_to_pos(spark, sf_dir):
    from pyspark.sql import Window
    s, _, _, _ = _scored(spark, sf_dir)
    w = Window.partitionBy(*LINE_ORDER).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cum = s.withColumn("cum", F.sum("lp").over(w))
    r = sc.cumulative_to_positional(cum, LINE_ORDER)
    return r.select(*LINE_ORDER, "pos", F.round("positional", R6).alias("positional"))


# ----------------------------------------------------------------------------------------
# alignments, lexicons, attention (conversation pairs, diagonal links, joint vocabulary)
# ----------------------------------------------------------------------------------------
from seqcorpus.operators import align as al  # noqa: E402


def _joint_vocab(spark, sf_dir):
    p = conversation_pairs(spark, sf_dir)
    src = p.select(F.lit(0).alias("side"), *PAIR_KEY, F.col("src_text").alias("text"))
    tgt = p.select(F.lit(1).alias("side"), *PAIR_KEY, F.col("tgt_text").alias("text"))
    return voc.build_vocab(src.unionByName(tgt), ["side", "conv_id", "turn"], threshold=2, nwords=8000)


def _aligned_pairs(spark, sf_dir):
    """Pairs with token ids (no eos) and diagonal links 'i-i' for i < min(len) as alignment text."""
    vocab = _joint_vocab(spark, sf_dir)
    p = conversation_pairs(spark, sf_dir, bounded=False).select(*PAIR_KEY, tokenize("src_text").alias("src_tok"),
                                                                tokenize("tgt_text").alias("tgt_tok"))
    p = enc.encode_tokens(p, vocab, "src_tok", "src_ids", append_eos=False)
    p = enc.encode_tokens(p, vocab, "tgt_tok", "tgt_ids", append_eos=False)
    n = F.least(F.size("src_ids"), F.size("tgt_ids"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(i.cast("string"), F.lit("-"), i.cast("string"))), " ")
    p = p.withColumn("align_text", F.when(n > 0, text).otherwise(F.lit("")))
    return p.withColumn("links", al.parse_alignment("align_text")), vocab


@register("src_12_read_alignments")
def q_read_alignments(spark, sf_dir):
    p, _ = _aligned_pairs(spark, sf_dir)
    return p.select(*PAIR_KEY, F.size("links").cast("long").alias("n_links"),
                    F.coalesce(F.element_at("links", -1)["src_pos"], F.lit(-1)).alias("last_src"))


@register("jn_04_alignment_tokens")
def q_link_tokens(spark, sf_dir):
    p, _ = _aligned_pairs(spark, sf_dir)
    return al.link_tokens(p, PAIR_KEY, "links", "src_ids", "tgt_ids").select(*PAIR_KEY, F.col("link_no").cast("int"), "src_id", "tgt_id")


def _cooc(spark, sf_dir):
    p, vocab = _aligned_pairs(spark, sf_dir)
    linked = al.known_pairs_only(al.link_tokens(p, PAIR_KEY, "links", "src_ids", "tgt_ids"))
    return al.cooccurrence(linked, ["conv_id", "turn", "link_no"]), vocab


@register("flt_08_known_pairs_only")
def q_known_pairs(spark, sf_dir):
    p, _ = _aligned_pairs(spark, sf_dir)
    linked = al.known_pairs_only(al.link_tokens(p, PAIR_KEY, "links", "src_ids", "tgt_ids"))
    return linked.groupBy(*PAIR_KEY).agg(F.count(F.lit(1)).alias("n_known"))


@register("agg_06_cooccurrence")
def q_cooccurrence(spark, sf_dir):
    c, _ = _cooc(spark, sf_dir)
    return c.select("src_id", "tgt_id", "cnt")


@register("agg_07_argmax_lexicon")
def q_argmax_lexicon(spark, sf_dir):
    c, _ = _cooc(spark, sf_dir)
    return al.argmax_lexicon(c)


@register("jn_05_replace_unk")
def q_replace_unk(spark, sf_dir):
    """Hypothesis = target decoded through the vocabulary (unknown → '<unk>'), diagonal alignment,
    lexicon = argmax lexicon in words."""
    p, vocab = _aligned_pairs(spark, sf_dir)
    c, _ = _cooc(spark, sf_dir)
    lex_ids = al.argmax_lexicon(c)
    v = vocab.select("id", "symbol")
    lexicon = (lex_ids.join(v.withColumnRenamed("id", "src_id").withColumnRenamed("symbol", "src"), "src_id")
               .join(v.withColumnRenamed("id", "tgt_id").withColumnRenamed("symbol", "tgt"), "tgt_id").select("src", "tgt"))
    hyp = enc.decode(p.select(*PAIR_KEY, "tgt_ids", "src_tok"), vocab, ids_col="tgt_ids", out_col="hyp_text")
    hyp = hyp.withColumn("hyp_tok", F.split("hyp_text", " ")).withColumn(
        "alignment", F.transform(F.sequence(F.lit(0), F.size("hyp_tok") - 1), lambda i: F.least(i, F.size("src_tok"))))
    r = al.replace_unk(hyp, PAIR_KEY, "hyp_tok", "src_tok", "alignment", lexicon)
    return r.select(*PAIR_KEY, F.md5("text").alias("text_md5"), F.col("n_replaced").cast("long"))


@register("agg_32_symmetrize")
def q_symmetrize(spark, sf_dir):
    """Intersection and union of the diagonal links with the links shifted by one source word."""
    p, _ = _aligned_pairs(spark, sf_dir)
    shifted = F.filter(F.transform("links", lambda l: F.struct((l["src_pos"] + 1).alias("src_pos"), l["tgt_pos"].alias("tgt_pos"))),
                       lambda l: l["src_pos"] < F.size("src_ids"))
    p = p.withColumn("shifted", shifted)
    return p.select(*PAIR_KEY, F.size(al.symmetrize("links", "shifted", "intersection")).cast("long").alias("n_inter"),
                    F.size(al.symmetrize("links", "shifted", "union")).cast("long").alias("n_union"))


def _attention(spark, sf_dir, width=2):
    pl = _pair_lengths(spark, sf_dir)
    return al.local_attention(pl, PAIR_KEY, "src_len", "tgt_len", width)


@register("win_04_topk_positions")
def q_topk(spark, sf_dir):
    t = al.topk_positions(_attention(spark, sf_dir), PAIR_KEY, 3)
    return t.groupBy(*PAIR_KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("src_pos").alias("sum_src"))


@register("win_05_hard_alignment")
def q_hard(spark, sf_dir):
    return al.hard_alignment(_attention(spark, sf_dir), PAIR_KEY)


@register("jn_10_attention_relay")
def q_relay(spark, sf_dir):
    """target→pivot attention (width 2) relayed through pivot→source attention (width 1)."""
    r = al.attention_relay(_attention(spark, sf_dir, 2), _attention(spark, sf_dir, 1), PAIR_KEY)
    return r.groupBy(*PAIR_KEY).agg(F.count(F.lit(1)).alias("n_cells"), F.sum("src_pos").alias("sum_src"))


@register("agg_20_attention_teaching_loss")
def q_att_loss(spark, sf_dir):
    student = _attention(spark, sf_dir, 2)
    relayed = al.attention_relay(_attention(spark, sf_dir, 2), _attention(spark, sf_dir, 1), PAIR_KEY)
    return al.attention_teaching_loss(student, relayed, PAIR_KEY).select(F.round("loss", 6).alias("loss"))


@register("agg_28_head_average_attention")
def q_head_avg(spark, sf_dir):
    heads = _attention(spark, sf_dir, 1).withColumn("head", F.lit(0)).unionByName(
        _attention(spark, sf_dir, 3).withColumn("head", F.lit(1)))
    h = al.head_average(heads, PAIR_KEY, n_heads=2)
    return h.groupBy(*PAIR_KEY).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("weight"), 6).alias("total"))


# ----------------------------------------------------------------------------------------
# checkpoints and embeddings (embeddings table: each row a checkpoint of one parameter)
# ----------------------------------------------------------------------------------------
from seqcorpus.operators import checkpoints as ck  # noqa: E402
from seqcorpus.operators import logs as lg  # noqa: E402
from seqcorpus.sources import files as fs  # noqa: E402
from seqcorpus.plans.session import scratch_path  # noqa: E402


def _ckpts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    flt = e.select(F.col("label").alias("run"), F.col("vec_id").alias("checkpoint"), F.lit("emb").alias("param"),
                   F.lit(0).alias("param_no"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
                   F.lit(False).alias("is_int"))
    ints = e.select(F.col("label").alias("run"), F.col("vec_id").alias("checkpoint"), F.lit("emb_int").alias("param"),
                    F.lit(1).alias("param_no"),
                    F.transform("embedding", lambda x: (x * 100).cast("int").cast("double")).alias("vector"),
                    F.lit(True).alias("is_int"))
    return flt.unionByName(ints)


@register("agg_25_average_checkpoints")
def q_avg_ckpt(spark, sf_dir):
    a = ck.average_checkpoints(_ckpts(spark, sf_dir), ["run"])
    return a.select("run", "param", F.size("vector").cast("long").alias("dim"),
                    F.round(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x), 4).alias("vsum"),
                    F.round(F.element_at("vector", 1), 6).alias("v0"))


@register("agg_26_check_same_keys")
def q_same_keys(spark, sf_dir):
    return ck.check_same_keys(_ckpts(spark, sf_dir), ["run"])


def _ckpt_files(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("checkpoint"), F.col("vec_id").cast("string"), F.lit(".pt")).alias("name"))


@register("win_13_last_n_checkpoints")
def q_last_n(spark, sf_dir):
    return ck.last_n_checkpoints(_ckpt_files(spark, sf_dir), 5, upper=400)


@register("win_14_prune_old_checkpoints")
def q_prune(spark, sf_dir):
    return ck.prune_old_checkpoints(_ckpt_files(spark, sf_dir), 10)


def _emb_words(spark, sf_dir):
    """Pretrained vectors keyed by the document vocabulary word whose id equals vec_id."""
    e = table(spark, sf_dir, "embeddings")
    v = doc_vocab(spark, sf_dir).select(F.col("id").cast("long").alias("vec_id"), "symbol")
    return (e.join(v, "vec_id").filter(~F.col("symbol").contains(" "))
            .select("symbol", F.col("embedding").alias("vector")))


@register("jn_06_embedding_vocab_join")
def q_attach(spark, sf_dir):
    j = ck.attach_embeddings(_joint_vocab(spark, sf_dir), _emb_words(spark, sf_dir), 64)
    return j.select("id", "symbol", "pretrained", F.size("vector").cast("long").alias("dim"),
                    F.round(F.element_at("vector", 1).cast("double"), 5).alias("v0"))


@register("jn_07_embedding_overlap")
def q_overlap(spark, sf_dir):
    return ck.embedding_overlap(_joint_vocab(spark, sf_dir), _emb_words(spark, sf_dir))


@register("set_03_embedding_vocab_intersect")
def q_emb_intersect(spark, sf_dir):
    return voc.vocab_intersect(_joint_vocab(spark, sf_dir), _emb_words(spark, sf_dir))


@register("src_11_read_embeddings")
def q_read_embeddings(spark, sf_dir):
    """Write the word vectors as a text embedding file (header + 'word v1 v2 ...'), read it back."""
    path = scratch_path(spark, "emb")
    e = _emb_words(spark, sf_dir)
    body = e.select(F.concat_ws(" ", "symbol", F.array_join(F.col("vector").cast("array<string>"), " ")).alias("text"))
    header = spark.createDataFrame([("%d 64" % 0,)], "text string")
    header.unionByName(body).write.mode("overwrite").text(path)  # the header is in the first part file
    r = fs.read_embeddings(spark, path)
    return r.select("symbol", F.size("vector").cast("long").alias("dim"),
                    F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 3).alias("vsum"))


# ----------------------------------------------------------------------------------------
# vocabulary / lexicon files, generation output, tagged text, synthetic corpus
# ----------------------------------------------------------------------------------------
@register("src_07_write_read_vocab")
def q_vocab_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "vocab")
    fs.write_vocab(doc_vocab(spark, sf_dir), path)
    return fs.read_vocab(spark, path)


@register("src_13_read_lexicon")
def q_lexicon_roundtrip(spark, sf_dir):
    c, vocab = _cooc(spark, sf_dir)
    v = vocab.select("id", "symbol")
    lex = (al.argmax_lexicon(c).join(v.withColumnRenamed("id", "src_id").withColumnRenamed("symbol", "src"), "src_id")
           .join(v.withColumnRenamed("id", "tgt_id").withColumnRenamed("symbol", "tgt"), "tgt_id"))
    path = scratch_path(spark, "lex")
    fs.write_lines(lex.select(F.concat_ws(" ", "src", "tgt").alias("text"), "src"), path, order_cols=["src"])
    return fs.read_lexicon(spark, path)


@register("src_17_read_tagged_text")
def q_tagged(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", r"\r\n|\r|\n|(?=<)")).alias("line_no", "text"))
    r = fs.read_tagged_text(pages)
    return r.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"),
                                    F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))),
                                                                   lambda x: x["text"]), "\n")).alias("text_md5"))


@register("src_18_read_sgm_segments")
def q_sgm(spark, sf_dir):
    """Title elements of the pages as the segment tag."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(<title>.*?</title>)", 1).alias("text"))
    r = fs.read_sgm_segments(pages, tag="title")
    return r.select("page_id", "text")


@register("src_21_synthetic_corpus")
def q_synthetic(spark, sf_dir):
    """A random-letter line for every document, seeded by its id."""
    s = fs.synthetic_lines(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 20, 42)
    return s.select("line_no", F.size(F.split("text", " ")).cast("long").alias("n_letters"))


@register("src_05_infer_language_pair")
def q_infer_pair(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("lang").distinct().select(
        F.concat(F.lit("train."), F.col("lang"), F.lit("-en.bin")).alias("name"))
    return fs.infer_language_pair(names)


# ----------------------------------------------------------------------------------------
# training logs rendered from the events table, then parsed back
# ----------------------------------------------------------------------------------------
def _log_lines(spark, sf_dir):
    """Every event becomes a progress line; the printer's three line styles by event type."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    ep = (F.col("user_id") % 100 + 1)
    mid = F.format_string("| epoch %03d:   %d / %d loss=%.3f, nll_loss=%.3f, ppl=%.2f, num_updates=%d, wall=%d",
                          ep, F.col("event_id"), F.lit(100000), F.col("value"), F.col("value") / 2,
                          F.pow(F.lit(2.0), F.col("value") / 2), F.col("event_id"), F.unix_timestamp("ts"))
    end = F.format_string("| epoch %03d | loss %.3f | nll_loss %.3f | ppl %.2f | num_updates %d | wall %d",
                          ep, F.col("value"), F.col("value") / 2, F.pow(F.lit(2.0), F.col("value") / 2),
                          F.col("event_id"), F.unix_timestamp("ts"))
    val = F.format_string("| epoch %03d | valid on 'valid' subset | valid_loss %.5f | valid_ppl %.2f | num_updates %d",
                          ep, F.col("value"), F.pow(F.lit(2.0), F.col("value")), F.col("event_id"))
    js = F.to_json(F.struct(F.col("event_id").alias("num_updates"), F.col("value").alias("loss")))
    text = (F.when(F.col("event_type") == "view", mid).when(F.col("event_type") == "click", end)
            .when(F.col("event_type") == "error", val).when(F.col("event_type") == "signup", js)
            .otherwise(F.concat(F.lit("| "), F.col("event_type"))))
    return ev.select("event_id", "user_id", text.alias("text"))


@register("src_16_read_train_log")
def q_train_log(spark, sf_dir):
    p = lg.parse_train_log(_log_lines(spark, sf_dir))
    return p.select("event_id", "kind", "epoch", "step", "subset", F.round("loss", 5).alias("loss"),
                    F.round(F.log2("ppl"), 3).alias("log2_ppl"), "num_updates")


@register("win_12_running_best")
def q_running_best(spark, sf_dir):
    p = lg.parse_train_log(_log_lines(spark, sf_dir)).filter(F.col("kind") == "valid")
    r = lg.running_best(p, ["user_id"], order_col="num_updates")
    return r.select("user_id", "num_updates", F.round("loss", 5).alias("loss"), F.round("best_so_far", 5).alias("best_so_far"), "is_best")


@register("agg_22_aggregate_logs")
def q_agg_logs(spark, sf_dir):
    """Worker outputs = events; update = 10-minute bucket; worker = user."""
    ev = table(spark, sf_dir, "events")
    out = ev.select(F.floor(F.unix_timestamp("ts") / 600).alias("update"), F.col("value").alias("loss"),
                    (F.col("value") / 2).alias("nll_loss"), F.lit(1).alias("nsentences"),
                    (F.col("user_id") % 7 + 1).alias("ntokens"), (F.col("user_id") % 7 + 1).alias("sample_size"))
    r = lg.aggregate_logs(out, ["update"])
    return r.select("update", F.round("loss", 6).alias("loss"), F.col("ntokens").cast("long").alias("ntokens"),
                    F.round("loss_bits", 6).alias("loss_bits"), F.round("nll_bits", 6).alias("nll_bits"))


@register("agg_23_weighted_average_meter")
def q_avg_meter(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("n", F.col("user_id") % 5 + 1)
    r = lg.weighted_average_meter(ev, ["event_type"], "value", "n", "ts")
    return r.select("event_type", F.round("avg", 6).alias("avg"), "last", F.col("count").cast("long").alias("count"))


@register("agg_24_rate_meter")
def q_rate_meter(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("n", F.lit(1))
    r = lg.rate_meter(ev, ["event_type"], "n", "ts")
    return r.select("event_type", F.col("n").cast("long").alias("n"), F.round("rate", 6).alias("rate"))


# ----------------------------------------------------------------------------------------
# streaming: the table files replayed as a stream; results read back from the sink
# ----------------------------------------------------------------------------------------
import uuid  # noqa: E402

from seqcorpus.streaming import streams as stm  # noqa: E402


def _run_dir(spark, tag):
    return scratch_path(spark, f"stream-{tag}-{uuid.uuid4().hex[:12]}")


@register("str_01_stream_encode")
def q_stream_encode(spark, sf_dir):
    d = _run_dir(spark, "encode")
    q = stm.stream_encode(stm.document_line_stream(spark, sf_dir), doc_vocab(spark, sf_dir),
                          f"{d}/out", f"{d}/ckpt")
    q.awaitTermination()
    r = spark.read.parquet(f"{d}/out")
    return r.select("doc_id", F.col("line_no").cast("long"), F.size("ids").cast("long").alias("n_ids"),
                    F.md5(_ids_str("ids")).alias("ids_md5"))


@register("str_02_stream_word_counts")
def q_stream_counts(spark, sf_dir):
    d = _run_dir(spark, "counts")
    q = stm.stream_word_counts(stm.document_line_stream(spark, sf_dir), f"{d}/out", f"{d}/ckpt")
    q.awaitTermination()
    r = spark.read.parquet(f"{d}/out")
    return r.groupBy("symbol").agg(F.max_by("count", "batch_id").alias("count"))


@register("str_03_stream_meters")
def q_stream_meters(spark, sf_dir):
    d = _run_dir(spark, "meters")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    ev = stm.table_stream(spark, sf_dir, "events", schema)
    q = stm.stream_meters(ev, f"{d}/out", f"{d}/ckpt")
    q.awaitTermination()
    r = spark.read.parquet(f"{d}/out")
    return r.select("window_start", "event_type", "n", F.round("total", 6).alias("total"))


@register("str_04_stream_score")
def q_stream_score(spark, sf_dir):
    d = _run_dir(spark, "score")
    vocab = doc_vocab(spark, sf_dir)

    def score(batch):
        return enc.encode_stats(batch, vocab, ["lang"])

    q = stm.stream_score(stm.document_line_stream(spark, sf_dir), score, f"{d}/out", f"{d}/ckpt", ["lang"])
    q.awaitTermination()
    r = spark.read.parquet(f"{d}/out")
    return r.groupBy("lang").agg(F.sum("nseq").alias("nseq"), F.sum("ntok").alias("ntok"), F.sum("nunk").alias("nunk"))


# ----------------------------------------------------------------------------------------
# text functions on document lines
# ----------------------------------------------------------------------------------------
from seqcorpus.functions import text as tx  # noqa: E402


@register("prj_14_lowercase")
def q_lower(spark, sf_dir):
    l = document_lines(spark, sf_dir, cols=())
    return l.select(*LINE_ORDER, F.md5(tx.lowercase("text")).alias("text_md5"))


@register("prj_15_mask_digits")
def q_mask(spark, sf_dir):
    l = document_lines(spark, sf_dir, cols=())
    m = tx.mask_digits("text")
    return l.filter(m != F.col("text")).select(*LINE_ORDER, m.alias("masked"))


@register("prj_16_unk_to_UNK")
def q_unk_upper(spark, sf_dir):
    d = q_decode(spark, sf_dir)
    u = tx.unk_to_UNK("text")
    return d.select(*LINE_ORDER, (F.size(F.split(u, "UNK")) - 1).cast("long").alias("n_unk"))


@register("prj_18_normalize_punct")
def q_norm(spark, sf_dir):
    l = document_lines(spark, sf_dir, cols=())
    return l.select(*LINE_ORDER, F.md5(tx.normalize_punct(tx.strip_nonprinting("text"))).alias("text_md5"))


@register("prj_07_remove_bpe")
def q_remove_bpe(spark, sf_dir):
    """Marks every word longer than 4 characters as two subword pieces, then removes the marker."""
    l = document_lines(spark, sf_dir, cols=())
    pieces = F.array_join(F.transform(tokenize("text"), lambda w: F.when(F.length(w) > 4, F.concat(
        F.substring(w, F.lit(1), F.lit(4)), F.lit("@@ "), F.substring(w, F.lit(5), F.length(w)))).otherwise(w)), " ")
    r = l.select(*LINE_ORDER, tx.remove_bpe(pieces).alias("restored"), F.array_join(tokenize("text"), " ").alias("orig"))
    return r.select(*LINE_ORDER, (F.col("restored") == F.col("orig")).alias("round_trip"), F.md5("restored").alias("text_md5"))


@register("prj_19_words_to_numbers")
def q_chars_to_numbers(spark, sf_dir):
    """Character-level vocabulary over all lines, every line rendered as character ids."""
    l = document_lines(spark, sf_dir, cols=()).withColumn("chars", tx.chars_as_words("text"))
    v = voc.build_vocab(l, LINE_ORDER, tokens_col="chars", padding_factor=1)
    e = enc.encode_tokens(l, v, "chars", "cids", append_eos=False)
    return e.select(*LINE_ORDER, F.md5(_ids_str("cids")).alias("ids_md5"))


# ----------------------------------------------------------------------------------------
# subwords: merges learned on the conversation word types, applied to document words
# ----------------------------------------------------------------------------------------
from seqcorpus.operators import bpe as bp  # noqa: E402

N_MERGES = 40


def _merges(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select(F.explode(tokenize("text")).alias("word"))
    words = conv.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return bp.learn_bpe(words, N_MERGES)


@register("agg_30_learn_bpe")
def q_learn_bpe(spark, sf_dir):
    return _merges(spark, sf_dir)


@register("prj_22_apply_bpe")
def q_apply_bpe(spark, sf_dir):
    lines = document_lines(spark, sf_dir, cols=())
    toks = voc.explode_tokens(lines, LINE_ORDER)
    seg = bp.apply_bpe(toks, _merges(spark, sf_dir))
    return seg.groupBy("symbol", "pieces").agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------------------------------
# set operations and buffered batching
# ----------------------------------------------------------------------------------------
from seqcorpus.plans.index import global_index as _gidx  # noqa: E402


@register("set_01_concat_datasets")
def q_concat(spark, sf_dir):
    """Bag union of the document lines and the conversation turns; ids continue across parts."""
    a = document_lines(spark, sf_dir, cols=()).select(F.lit(0).alias("corpus_ord"), F.col("doc_id").alias("k1"),
                                                       F.col("line_no").alias("k2"))
    b = table(spark, sf_dir, "conversations").select(F.lit(1).alias("corpus_ord"), F.col("conv_id").alias("k1"),
                                                     F.col("turn").alias("k2"))
    return _gidx(a.unionByName(b), ["corpus_ord", "k1", "k2"], name="id")


@register("bat_05_buffered_batches")
def q_buffered(spark, sf_dir):
    lines = document_lines(spark, sf_dir, cols=()).select(*LINE_ORDER, (F.size(tokenize("text")) + 1).alias("src_len"))
    idx = _gidx(lines, LINE_ORDER, name="line_idx")
    return bt.buffered_batches(idx, "line_idx", 1000, MAX_TOKENS, None)

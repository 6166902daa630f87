"""Registered queries of file formats, corpus sets, id functions and word scores, each with its DuckDB oracle."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from seqcorpus.functions import arrays as ar
from seqcorpus.functions.text import PUNCT_REPLACEMENTS, arrow_words, split_lines, tokenize
from seqcorpus.operators import align as al
from seqcorpus.operators import batching as bt
from seqcorpus.operators import blocks as blk
from seqcorpus.operators import encode as enc
from seqcorpus.operators import model_scoring as ms
from seqcorpus.operators import scoring as sc
from seqcorpus.operators import vocab as voc
from seqcorpus.plans.broadcast import maybe_broadcast, stored
from seqcorpus.plans.catalog import LINE_ORDER, PAIR_KEY, R6, _aligned_pairs, _batches, _cooc, _ids_str, _pair_lengths, doc_vocab, register
from seqcorpus.plans.index import global_index
from seqcorpus.plans.oracle import BATCHES, DOC, DOC_LANG, ENC, ORACLE, PAIRS_CTE, PLEN, WS, attention_cte, lines_cte, scored_ctes, tok, vocab_ctes
from seqcorpus.plans.session import cut_lineage, scratch_path
from seqcorpus.sources import files as fs
from seqcorpus.sources import indexed as ix
from seqcorpus.sources import parallel as par
from seqcorpus.sources.tables import conversation_pairs, document_lines, table
from seqcorpus.streaming import streams as stm


def _encoded(spark, sf_dir):
    return enc.encode_lines(document_lines(spark, sf_dir, cols=()), doc_vocab(spark, sf_dir)).select(*LINE_ORDER, "ids")


# --- files ----------------------------------------------------------------------------------
PARTS = 3


@register("src_04_load_split")
def q_load_split(spark, sf_dir):
    """The documents' lines in three files of one split, found by name and read on as one corpus."""
    folder = scratch_path(spark, "split")
    lines = cut_lineage(document_lines(spark, sf_dir, cols=()))
    for k in range(PARTS):
        name = "train" if k == 0 else f"train{k}"
        fs.write_lines(lines.where(F.col("doc_id") % PARTS == k), f"{folder}/{name}.en-de.en", order_cols=LINE_ORDER)
    got = fs.load_split(spark, fs.split_parts(spark, folder, "train", "de", "en", "en"))
    return got.select("corpus_ord", "id", F.md5("text").alias("text_md5"))


@register("src_06_split_from_prefixes")
def q_split_from_prefixes(spark, sf_dir):
    """Validation prefixes named by source; each one's lines under the split that its place in the list gives."""
    folder = scratch_path(spark, "prefixes")
    names = [r.source for r in table(spark, sf_dir, "documents").select("source").distinct().orderBy("source").collect()]  # a few sources
    lines = cut_lineage(document_lines(spark, sf_dir, cols=("source",)))
    out = None
    for source, split in zip(names, fs.split_names(",".join(names)), strict=True):
        path = f"{folder}/{split}"
        fs.write_lines(lines.where(F.col("source") == source), path, order_cols=LINE_ORDER)
        part = fs.read_lines(spark, path, per_file=False, split=split).select("split", "line_no", F.md5("text").alias("text_md5"))
        out = part if out is None else out.unionByName(part)
    return out


@register("src_08_read_indexed")
def q_read_indexed(spark, sf_dir):
    """The encoded lines written as a binary indexed dataset and read back."""
    path = scratch_path(spark, "indexed")
    ix.write_indexed(_encoded(spark, sf_dir), path, LINE_ORDER)
    got = ix.read_indexed(spark, path, items=5000)
    return got.select("item", F.element_at("dims", 1).alias("n_ids"), F.md5(_ids_str("ids")).alias("ids_md5"))


@register("src_09_write_indexed")
def q_write_indexed(spark, sf_dir):
    """What the index of the written dataset says of a range of items: read with the range pruned."""
    path = scratch_path(spark, "indexed-range")
    ix.write_indexed(_encoded(spark, sf_dir), path, LINE_ORDER)
    got = ix.read_indexed(spark, path, items=500).where((F.col("item") >= 1000) & (F.col("item") < 3000))
    return got.select("item", F.element_at("dims", 1).alias("n_ids"), F.element_at("ids", -1).alias("last_id"))


@register("src_10_write_raw")
def q_write_raw(spark, sf_dir):
    """The lines written as they are under split and language, and counted as they come back."""
    path = scratch_path(spark, "raw")
    lines = document_lines(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 23 == 0, "valid").otherwise("train"))
    fs.write_raw(lines, path, order_cols=LINE_ORDER)
    got = fs.read_raw(spark, path)
    return got.groupBy("split", "lang", F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@register("src_20_read_multi_reference")
def q_multi_reference(spark, sf_dir):
    """Turns t+1 and t+2 as the references of turn t."""
    p = conversation_pairs(spark, sf_dir, pivot=True)
    refs = p.select(*PAIR_KEY, F.lit(0).alias("ref_no"), F.col("tgt_text").alias("text")).unionByName(
        p.where("pivot_text IS NOT NULL").select(*PAIR_KEY, F.lit(1).alias("ref_no"), F.col("pivot_text").alias("text")))
    r = par.multi_reference(refs, PAIR_KEY)
    return r.select(*PAIR_KEY, F.size("refs").cast("long").alias("n_refs"), F.md5(F.array_join("refs", "\n")).alias("refs_md5"))


#: Lines of an Arrow batch of hypotheses.
BATCH_LINES = 1000


def _hypotheses(spark, sf_dir, n):
    """The n best lines of every document as hypotheses, its first line as source and target.  Lines stay rows of arrays; only those of
    documents whose id occurs again are grouped by their key.  Arrow batches are small, so that a worker's arrays are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_LINES))
    vocab = cut_lineage(doc_vocab(spark, sf_dir))
    size = vocab.count()
    lines = enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab).select(*LINE_ORDER, "text", "ids")
    model, unseen = sc.bigram_model(sc.positions(lines, [], nested=True), size, 1.0)
    scored = sc.label_gather(sc.positions(lines.where("doc_id IS NOT NULL"), [*LINE_ORDER, "text"], nested=True), model, unseen)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    score = F.round(add("lps") / F.size("lps"), 4).alias("score")
    columns = [F.col("doc_id").alias("id"), "line_no", "score", F.col("text").alias("hypothesis"), F.col("lps").alias("pos_scores")]
    again = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = stored(again.select("doc_id"))
    if again.isEmpty():
        h = scored.select("*", score).select(*columns)
    else:
        again = maybe_broadcast(again)
        met = scored.join(again, "doc_id", "left_semi")
        numbered = F.flatten(F.collect_list(F.transform("lps", lambda x, i: F.struct(i.alias("pos"), x.alias("lp")))))
        per_line = met.groupBy(*LINE_ORDER).agg(F.transform(F.array_sort(numbered), lambda x: x["lp"]).alias("lps")).withColumn("score", score)
        h = scored.join(again, "doc_id", "left_anti").select("*", score).select(*columns).unionByName(
            per_line.join(met.select(*LINE_ORDER, "text"), LINE_ORDER).select(*columns))
    first = document_lines(spark, sf_dir, cols=()).where("line_no = 0").select(F.col("doc_id").alias("id"), F.col("text").alias("source"),
                                                                            F.concat(F.lit("> "), "text").alias("target"))
    return sc.nbest(h, ["id"], n, tie_cols=["line_no"]).join(first, "id")


@register("src_15_write_generation_output")
def q_gen_write(spark, sf_dir):
    """The two best lines of every document in the printer's format."""
    out = fs.write_generation_output(_hypotheses(spark, sf_dir, 2))
    return out.select("id", "o", F.md5("line").alias("line_md5"))


@register("src_14_read_generation_output")
def q_gen_read(spark, sf_dir):
    """The printed lines written to files and read back as hypotheses."""
    path = scratch_path(spark, "gen")
    fs.write_lines(fs.write_generation_output(_hypotheses(spark, sf_dir, 2)), path, text_col="line", order_cols=["id", "o"], compression="gzip")
    back = fs.read_generation_output(fs.read_lines(spark, path, per_file=False))
    return back.select("id", F.col("rank").cast("int").alias("rank"), "score", *[F.md5(c).alias(f"{c}_md5") for c in ("hypothesis", "source", "target")])


HYPS = f"""{scored_ctes()},
per AS (SELECT doc_id, line_no, round(sum(lp) / count(*), 4) AS score, string_agg(printf('%.4f', lp), ' ' ORDER BY pos) AS ps FROM scored GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS rank FROM per QUALIFY rank <= 2),
hyp AS (SELECT b.doc_id AS id, b.rank, b.score, b.ps, l.text AS hypothesis, s.text AS source, '> ' || s.text AS target
        FROM best b JOIN lines l USING (doc_id, line_no) JOIN lines s ON s.doc_id = b.doc_id AND s.line_no = 0)"""
ORACLE["src_15_write_generation_output"] = f"""WITH {HYPS}
SELECT id, CAST(0 AS BIGINT) AS o, md5('S-' || id || chr(9) || source) AS line_md5 FROM hyp WHERE rank = 1
UNION ALL SELECT id, CAST(1 AS BIGINT), md5('T-' || id || chr(9) || target) FROM hyp WHERE rank = 1
UNION ALL SELECT id, CAST(3 * rank AS BIGINT), md5('H-' || id || chr(9) || score || chr(9) || hypothesis) FROM hyp
UNION ALL SELECT id, CAST(3 * rank + 1 AS BIGINT), md5('P-' || id || chr(9) || ps) FROM hyp"""
ORACLE["src_14_read_generation_output"] = f"""WITH {HYPS}
SELECT id, CAST(rank AS INTEGER) AS rank, score, md5(hypothesis) AS hypothesis_md5, md5(source) AS source_md5, md5(target) AS target_md5 FROM hyp"""
ORACLE["src_04_load_split"] = f"""WITH {lines_cte('')}
SELECT CAST(doc_id % {PARTS} AS INTEGER) AS corpus_ord, row_number() OVER (ORDER BY doc_id % {PARTS}, doc_id, line_no) - 1 AS id, md5(text) AS text_md5 FROM lines"""
ORACLE["src_06_split_from_prefixes"] = f"""WITH {lines_cte('source')},
s AS (SELECT source, 'valid' || CASE WHEN row_number() OVER (ORDER BY source) = 1 THEN '' ELSE CAST(row_number() OVER (ORDER BY source) - 1 AS VARCHAR) END AS split
      FROM (SELECT DISTINCT source FROM documents))
SELECT split, row_number() OVER (PARTITION BY source ORDER BY doc_id, line_no) - 1 AS line_no, md5(text) AS text_md5 FROM lines JOIN s USING (source)"""
INDEXED = f"""{ENC},
e AS (SELECT doc_id, line_no, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos) AS s, count(*) AS n FROM tv GROUP BY ALL),
items AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS item, CAST(coalesce(e.n, 0) + 1 AS BIGINT) AS n_ids, coalesce(e.s || ' 2', '2') AS ids
          FROM tl LEFT JOIN e USING (doc_id, line_no))"""
ORACLE["src_08_read_indexed"] = f"WITH {INDEXED} SELECT item, n_ids, md5(ids) AS ids_md5 FROM items"
ORACLE["src_09_write_indexed"] = f"WITH {INDEXED} SELECT item, n_ids, CAST(2 AS BIGINT) AS last_id FROM items WHERE item >= 1000 AND item < 3000"
ORACLE["src_10_write_raw"] = f"""WITH {lines_cte()}
SELECT CASE WHEN doc_id % 23 = 0 THEN 'valid' ELSE 'train' END AS split, lang, md5(text) AS text_md5, count(*) AS n FROM lines GROUP BY ALL"""
ORACLE["src_20_read_multi_reference"] = f"""WITH {PAIRS_CTE}
SELECT p.conv_id, p.turn, CAST(1 + CASE WHEN r.text IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_refs,
       md5(p.tgt_text || coalesce(chr(10) || r.text, '')) AS refs_md5
FROM pairs p LEFT JOIN conversations r ON r.conv_id = p.conv_id AND r.turn = p.turn + 2"""


# --- corpora ----------------------------------------------------------------------------------
@register("set_02_concat_corpora")
def q_concat_corpora(spark, sf_dir):
    """Per language the document lines, then the benchmark's lines (taken as English), as one corpus."""
    docs = document_lines(spark, sf_dir).select("lang", F.col("doc_id").alias("k1"), F.col("line_no").alias("k2"), "text")
    bench = table(spark, sf_dir, "benchmark").select(F.lit("en").alias("lang"), F.col("item_id").alias("k1"), F.posexplode(split_lines("text")).alias("k2", "text"))
    got = par.concat_corpora([docs, bench.withColumn("k2", F.col("k2").cast("long"))], ["lang"], ["k1", "k2"])
    return got.select("lang", "corpus_ord", "line", F.md5("text").alias("text_md5"))


@register("srt_02_lm_order")
def q_lm_order(spark, sf_dir):
    """Both orders of the lines by size: plain, and with the sizes mirrored."""
    sizes = cut_lineage(document_lines(spark, sf_dir, cols=()).select(*LINE_ORDER, (F.size(tokenize("text")) + 1).alias("size")))
    plain = bt.lm_order(sizes, LINE_ORDER).select("idx", "ord", F.lit(False).alias("mirrored"))
    return plain.unionByName(bt.lm_order(sizes, LINE_ORDER, mirrored=True).select("idx", "ord", F.lit(True).alias("mirrored")))


@register("jn_12_order_restore")
def q_order_restore(spark, sf_dir):
    """Results made in batch order, numbered in the order of their input again."""
    done = _batches(spark, sf_dir).select("batch_id", "pos_in_batch", *PAIR_KEY, (F.col("src_len") + F.col("tgt_len")).alias("result"))
    back = par.restore_order(done.withColumn("id", F.struct(*PAIR_KEY)), "id")
    return global_index(back, ["id"], name="place").select("place", *PAIR_KEY, "result")


@register("bat_02_collate")
def q_collate(spark, sf_dir):
    """4-way rows collated: source, target and decoder input, pivot and machine output padded to the longest of the batch."""
    p = conversation_pairs(spark, sf_dir, pivot=True)
    vocab = voc.build_vocab(p.select(F.lit(0).alias("side"), *PAIR_KEY, F.col("src_text").alias("text")), ["side", *PAIR_KEY], threshold=2)
    vocab = cut_lineage(vocab)
    rows = p.select(*PAIR_KEY, *[tokenize(c).alias(c) for c in ("src_text", "tgt_text")], tokenize(F.coalesce("pivot_text", F.lit(""))).alias("pivot_text"))
    for col, out in (("src_text", "src_ids"), ("tgt_text", "tgt_ids"), ("pivot_text", "pivot_ids")):
        rows = enc.encode_tokens(rows, vocab, col, out)
    rows = rows.withColumn("mt_ids", F.when(F.size("pivot_ids") > 1, F.reverse("tgt_ids")))
    rows = rows.join(_batches(spark, sf_dir).select(*PAIR_KEY, "batch_id"), PAIR_KEY)
    c = bt.collate(rows, id_cols=PAIR_KEY, others={"pivot_ids": "pivot", "mt_ids": "mt"})
    pads = lambda col: F.size(F.filter(col, lambda x: x == 1)).cast("long")
    return c.select(*PAIR_KEY, "batch_id", "row_in_batch", *[F.size(x).cast("long").alias(f"n_{x}") for x in ("source", "target", "prev_output", "pivot", "mt")],
                    *[pads(x).alias(f"pads_{x}") for x in ("source", "target", "pivot", "mt")], F.element_at("source", -1).alias("last_source"),
                    F.element_at("prev_output", 1).alias("first_prev"))


ORACLE["set_02_concat_corpora"] = f"""WITH {lines_cte()},
b AS (SELECT item_id, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM benchmark),
u AS (SELECT lang, 0 AS corpus_ord, doc_id AS k1, line_no AS k2, text FROM lines
      UNION ALL SELECT 'en', 1, item_id, CAST(unnest(generate_series(0, len(parts) - 1)) AS BIGINT), unnest(parts) FROM b)
SELECT lang, corpus_ord, row_number() OVER (PARTITION BY lang ORDER BY corpus_ord, k1, k2) - 1 AS line, md5(text) AS text_md5 FROM u"""
ORACLE["srt_02_lm_order"] = f"""WITH {DOC},
s AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS idx, len(t) + 1 AS size FROM tl),
m AS (SELECT a.idx, b.size FROM s a JOIN s b ON b.idx = (SELECT count(*) FROM s) - 1 - a.idx)
SELECT idx, row_number() OVER (ORDER BY size, idx) - 1 AS ord, false AS mirrored FROM s
UNION ALL SELECT idx, row_number() OVER (ORDER BY size, idx) - 1 AS ord, true AS mirrored FROM m"""
ORACLE["jn_12_order_restore"] = f"""WITH {PLEN}
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS place, conv_id, turn, src_len + tgt_len AS result FROM plen WHERE src_len <= 1024 AND tgt_len <= 1024"""


# --- id functions ----------------------------------------------------------------------------
WIDTH = 40


@register("prj_08_pad_and_shift")
def q_pad_and_shift(spark, sf_dir):
    """PRJ-08 to PRJ-12 and PRJ-20 on every encoded line: padded to 40 on either side, stripped, shifted, turned over and numbered."""
    e = _encoded(spark, sf_dir).withColumn("left", ar.pad_to("ids", WIDTH, True)).withColumn("right", ar.pad_to("ids", WIDTH, False))
    cols = {"strip": ar.strip_pad("left"), "shift": ar.shift_eos_first("ids"), "to_right": ar.convert_padding_direction("left", True),
            "to_left": ar.convert_padding_direction("right", False), "left_pos": ar.make_positions("left", True),
            "right_pos": ar.make_positions("right", False), "prefix": ar.first_n("ids", 5)}
    return e.select(*LINE_ORDER, *[F.md5(F.array_join(c.cast("array<string>"), " ")).alias(n) for n, c in cols.items()])


@register("prj_13_band")
def q_band(spark, sf_dir):
    """Frequency bands of every vocabulary id: label in the head, band, label in the band's tail."""
    vocab = cut_lineage(doc_vocab(spark, sf_dir))
    head, band, tail = ar.band_labels("id", [100, 1000], vocab.count())
    return vocab.select("id", head.cast("int").alias("head"), band.cast("int").alias("band"), tail.cast("int").alias("tail"))


@register("prj_21_effective_max_positions")
def q_max_positions(spark, sf_dir):
    """Rows that survive each pair of caps of dataset and model."""
    rows, out = cut_lineage(_pair_lengths(spark, sf_dir)), None
    for data, model in ((None, None), (64, None), (None, 32), (64, 16)):
        cap = ar.effective_max_positions(data, model)
        kept = bt.valid_size(rows, cap, cap).agg(F.count(F.lit(1)).alias("n_kept")).select(F.lit(cap).alias("cap"), F.lit(data).cast("int").alias("data"), F.lit(model).cast("int").alias("model"), "n_kept")
        out = kept if out is None else out.unionByName(kept)
    return out


@register("flt_05_drop_single_token_sentences")
def q_drop_single(spark, sf_dir):
    """Encoded lines of more than the sentence end."""
    return blk.blocks_eos(_encoded(spark, sf_dir).withColumn("size", F.size("ids"))).select(*LINE_ORDER, F.col("size").cast("long").alias("n_ids"))


@register("flt_06_non_pad_mask")
def q_non_pad(spark, sf_dir):
    """Loss over the positions of right-padded lines that are no pads."""
    e = _encoded(spark, sf_dir).withColumn("ids", ar.pad_to("ids", WIDTH, False))
    rows = e.select("doc_id", F.explode("ids").alias("token")).withColumn("lp", -F.log(F.col("token") + 1.0))
    return sc.nll_loss(rows, ["doc_id"]).select("doc_id", F.round("loss", 4).alias("loss"), "ntokens")


ORACLE["prj_08_pad_and_shift"] = f"""WITH {ENC},
e AS (SELECT doc_id, line_no, list(id ORDER BY pos) AS ids FROM tv GROUP BY ALL),
i AS (SELECT doc_id, line_no, list_append(coalesce(e.ids, CAST([] AS INTEGER[])), 2) AS ids FROM tl LEFT JOIN e USING (doc_id, line_no)),
p AS (SELECT *, list_transform(range(greatest({WIDTH} - len(ids), 0)), lambda x: 1) AS pad FROM i),
f AS (SELECT *, list_concat(pad, ids) AS l, list_concat(ids, pad) AS r, list_transform(range(len(ids)), lambda x: x + 2) AS num FROM p)
SELECT doc_id, line_no, md5(array_to_string(ids, ' ')) AS strip, md5(array_to_string(list_concat([2], ids[:-2]), ' ')) AS shift,
       md5(array_to_string(r, ' ')) AS to_right, md5(array_to_string(l, ' ')) AS to_left, md5(array_to_string(list_concat(pad, num), ' ')) AS left_pos,
       md5(array_to_string(list_concat(num, pad), ' ')) AS right_pos, md5(array_to_string(ids[:5], ' ')) AS prefix FROM f"""
ORACLE["prj_13_band"] = f"""WITH {DOC}, {vocab_ctes(2, 30000)}
SELECT id, CAST(CASE WHEN id < 100 THEN id WHEN id < 1000 THEN 99 + 0 ELSE 100 END AS INTEGER) AS head,
       CAST(CASE WHEN id < 100 THEN 0 WHEN id < 1000 THEN 1 ELSE 2 END AS INTEGER) AS band,
       CAST(CASE WHEN id < 100 THEN NULL WHEN id < 1000 THEN id - 100 ELSE id - 1000 END AS INTEGER) AS tail FROM vocab"""
ORACLE["prj_21_effective_max_positions"] = f"""WITH {PLEN},
caps AS (SELECT * FROM (VALUES (1024, NULL, NULL), (64, 64, NULL), (32, NULL, 32), (16, 64, 16)) AS c(cap, data, model))
SELECT cap, CAST(data AS INTEGER) AS data, CAST(model AS INTEGER) AS model, count(conv_id) AS n_kept
FROM caps LEFT JOIN plen ON src_len <= cap AND tgt_len <= cap GROUP BY ALL"""
ORACLE["flt_05_drop_single_token_sentences"] = f"WITH {DOC} SELECT doc_id, line_no, CAST(len(t) + 1 AS BIGINT) AS n_ids FROM tl WHERE len(t) >= 1"
ORACLE["flt_06_non_pad_mask"] = f"""WITH {ENC},
a AS (SELECT doc_id, CAST(id AS INTEGER) AS id FROM tv UNION ALL SELECT doc_id, 2 AS id FROM tl)
SELECT doc_id, round(sum(ln(id + 1.0::DOUBLE)), 4) AS loss, count(*) AS ntokens FROM a WHERE id <> 1 GROUP BY doc_id"""


# --- word scores, attention targets, model scores ------------------------------------------------
#: Piece counts that are shipped as one Arrow table, within the bytes of a broadcast.
MAX_PIECES = 8_000_000


def _split_words(batches):
    """Arrow batches whose last column is a text -> with the pieces of its words instead, words over four letters as two."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        at, words = arrow_words(text)
        long = pc.greater(pc.utf8_length(words), 4)
        two = long.to_numpy(zero_copy_only=False)
        heads = pc.if_else(long, pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, 4), "@@", ""), words)
        # the tails stand behind all heads, and are taken in between
        tails = pc.utf8_slice_codeunits(words.filter(long), 4)
        before = np.concatenate([[0], np.cumsum(1 + two)])
        place = np.empty(before[-1], np.int64)
        place[before[:-1]] = np.arange(len(words))
        place[before[:-1][two] + 1] = len(words) + np.arange(len(tails))
        pieces = pa.concat_arrays([heads, tails]).take(pa.array(place))
        lists = pa.ListArray.from_arrays(pa.array(before[at], pa.int32()), pieces)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "piece"])


def _pieces(lines):
    """Lines with the arrays ``piece`` and ``score``.  Words over four letters are two pieces; a piece's score is
    ln((count - 1) / total), so that of one seen once is infinite."""
    keys = "doc_id long, line_no long, lang string"
    split = lambda rows: rows.select(F.col("doc_id").cast("long"), "line_no", "lang", "text").mapInArrow(_split_words, f"{keys}, piece array<string>")
    counts = stored(voc.count_pieces(split(lines), "piece"))
    total = counts.agg(F.sum("count")).first()[0] or 0  # one scalar
    table_ = counts.where("count > 1").select("symbol", F.log((F.col("count") - 1) / F.lit(float(total))).alias("id"))
    return lambda rows: enc.looked_up(split(rows), table_, "piece", "score", float("-inf"), MAX_PIECES)


def _words_of_pieces(spark, sf_dir, operator):
    """An operator on the pieces of every line.  A line is a row of arrays; only lines whose key occurs again are exploded, and their
    pieces meet by the key."""
    lines = document_lines(spark, sf_dir)
    scored = _pieces(lines)
    again = lines.groupBy(*[F.col(c).alias(f"_{c}") for c in LINE_ORDER]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = stored(again)
    if again.isEmpty():
        return operator(scored(lines), LINE_ORDER)
    again = maybe_broadcast(again)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in LINE_ORDER])
    met = scored(lines.join(again, on, "left_semi"))
    met = met.select(*LINE_ORDER, F.posexplode(F.arrays_zip("piece", "score")).alias("pos", "_z")).select(*LINE_ORDER, "pos", "_z.piece", "_z.score")
    return operator(scored(lines.join(again, on, "left_anti")), LINE_ORDER).unionByName(operator(met, LINE_ORDER))


@register("win_10_merge_bpe_scores")
def q_merge_scores(spark, sf_dir):
    words = _words_of_pieces(spark, sf_dir, sc.merge_bpe_scores)
    return words.select(*LINE_ORDER, F.col("word_no").cast("long").alias("word_no"), "word", F.round("score", R6).alias("score"), F.col("n_merged").cast("long").alias("n_merged"))


@register("win_11_word_probs")
def q_word_probs(spark, sf_dir):
    words = _words_of_pieces(spark, sf_dir, sc.word_probs)
    return words.select(*LINE_ORDER, F.col("word_no").cast("long").alias("word_no"), "word", F.round("score", R6).alias("score"), F.col("n_pieces").cast("long").alias("n_pieces"))


@register("flt_07_drop_inf_scores")
def q_drop_inf(spark, sf_dir):
    """Per language: pieces that keep a finite score, their sum, and those removed."""
    lines = document_lines(spark, sf_dir)
    rows = _pieces(lines)(lines).select("lang", F.explode(F.arrays_zip("piece", "score")).alias("_z")).select("lang", "_z.piece", "_z.score")
    kept, gone = sc.drop_inf(rows, "score")
    kept = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_kept"), F.round(F.sum("score"), 3).alias("total"))
    gone = gone.groupBy("lang").agg(F.count(F.lit(1)).alias("n_gone"), F.min("piece").alias("first_gone"))
    return kept.join(gone, "lang", "full_outer")


@register("flt_10_mask_source_pad")
def q_mask_source_pad(spark, sf_dir):
    """Attention over sources padded by two on the right; targets at pads become 0."""
    lens = cut_lineage(_pair_lengths(spark, sf_dir))
    att = al.local_attention(lens.withColumn("src_len", F.col("src_len") + 2), PAIR_KEY, "src_len", "tgt_len", 2)
    places = F.transform(F.sequence(F.lit(0), F.col("src_len") + 1), lambda i: F.when(i < F.col("src_len"), 2).otherwise(1))
    ids = lens.select(*PAIR_KEY, F.posexplode(places).alias("src_pos", "src_id"))
    masked = al.mask_source_pad(att, ids, PAIR_KEY)
    return masked.groupBy(*PAIR_KEY).agg(F.count(F.lit(1)).alias("n_cells"), F.sum((F.col("weight") == 0).cast("long")).alias("n_masked"), F.round(F.sum("weight"), R6).alias("total"))


@register("scr_01_score_reference")
def q_score_reference(spark, sf_dir):
    """Every line scored by a model function: add-one unigram probabilities, a bounded array of the vocabulary's size."""
    vocab = cut_lineage(doc_vocab(spark, sf_dir))
    counts = {r.id: r["count"] for r in vocab.select("id", "count").collect()}  # at most the vocabulary's cap
    table_ = np.array([counts[i] for i in range(len(counts))], np.float64)
    shared = spark.sparkContext.broadcast(np.log((table_ + 1) / (table_.sum() + len(table_))))

    def load_model():
        lp = shared.value
        return lambda batch: lp[batch["target"]]

    lines = enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab).select(*LINE_ORDER, "ids")
    scored = ms.positional(ms.score_reference(lines, LINE_ORDER, load_model), LINE_ORDER)
    return sc.sequence_score(scored, LINE_ORDER).select(*LINE_ORDER, F.round("score", R6).alias("score"), "length")


@register("scr_06_post_process")
def q_post_process(spark, sf_dir):
    """Targets as hypotheses: decoded, unknown words replaced through the lexicon, split into words again."""
    p, vocab = _aligned_pairs(spark, sf_dir)
    c, _ = _cooc(spark, sf_dir)
    v = cut_lineage(vocab.select("id", "symbol"))
    lexicon = (al.argmax_lexicon(c).join(v.withColumnRenamed("id", "src_id").withColumnRenamed("symbol", "src"), "src_id")
               .join(v.withColumnRenamed("id", "tgt_id").withColumnRenamed("symbol", "tgt"), "tgt_id").select("src", "tgt"))
    places = F.sequence(F.lit(0), F.greatest(F.size("tgt_ids") - 1, F.lit(0)))
    hyp = p.select(*PAIR_KEY, F.col("tgt_ids").alias("ids"), F.col("src_tok").alias("src_tokens"),
                   F.transform(places, lambda i: F.least(i, F.size("src_tok"))).alias("alignment"))
    r = sc.post_process(hyp, PAIR_KEY, v, lexicon)
    return r.select(*PAIR_KEY, F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("text_md5"))


PIECES = f"""{DOC_LANG},
w AS (SELECT doc_id, line_no, lang, pos AS wpos, symbol, CASE WHEN length(symbol) > 4 THEN [substring(symbol, 1, 4) || '@@', substring(symbol, 5)] ELSE [symbol] END AS ps FROM toks),
pc AS (SELECT doc_id, line_no, lang, wpos, symbol, unnest(ps) AS piece, unnest(generate_series(1, len(ps))) AS k, len(ps) AS n FROM w),
cnt AS (SELECT piece, count(*) AS c FROM pc GROUP BY piece),
sp AS (SELECT pc.*, CASE WHEN c > 1 THEN ln((c - 1) / CAST((SELECT count(*) FROM pc) AS DOUBLE)) ELSE '-inf'::DOUBLE END AS score FROM pc JOIN cnt USING (piece)),
ends AS (SELECT *, CASE WHEN ends_with(piece, '@@') AND lead(wpos) OVER wn IS NOT NULL THEN 0 ELSE 1 END AS word_end FROM sp
         WINDOW wn AS (PARTITION BY doc_id, line_no ORDER BY wpos, k)),
no AS (SELECT *, coalesce(sum(word_end) OVER (PARTITION BY doc_id, line_no ORDER BY wpos, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS word_no FROM ends),
ww AS (SELECT doc_id, line_no, CAST(word_no AS BIGINT) AS word_no, string_agg(CASE WHEN word_end = 0 THEN piece[:-3] ELSE piece END, '' ORDER BY wpos, k) AS word,
              sum(score) AS score, CAST(count(*) - 1 AS BIGINT) AS n_merged FROM no GROUP BY ALL)"""
ORACLE["win_10_merge_bpe_scores"] = f"WITH {PIECES} SELECT doc_id, line_no, word_no, word, round(score, 6) AS score, n_merged FROM ww"
ORACLE["win_11_word_probs"] = f"""WITH {PIECES}
SELECT doc_id, line_no, word_no, word, CASE WHEN isfinite(score) THEN round(score, 6) END AS score, n_merged + 1 AS n_pieces FROM ww"""
ORACLE["flt_07_drop_inf_scores"] = f"""WITH {PIECES}
SELECT lang, count(*) FILTER (isfinite(score)) AS n_kept, round(sum(score) FILTER (isfinite(score)), 3) AS total,
       count(*) FILTER (NOT isfinite(score)) AS n_gone, min(piece) FILTER (NOT isfinite(score)) AS first_gone FROM sp GROUP BY lang"""
ORACLE["flt_10_mask_source_pad"] = f"""WITH {PLEN.replace("plen AS (", "qlen AS (")}, plen AS (SELECT conv_id, turn, src_len + 2 AS src_len, tgt_len FROM qlen),
{attention_cte('att', 2)},
m AS (SELECT conv_id, turn, CASE WHEN src_pos >= q.src_len THEN 0 ELSE weight END AS weight FROM att JOIN qlen q USING (conv_id, turn))
SELECT conv_id, turn, count(*) AS n_cells, CAST(count(*) FILTER (weight = 0) AS BIGINT) AS n_masked, round(sum(weight), 6) AS total FROM m GROUP BY ALL"""
ORACLE["scr_01_score_reference"] = f"""WITH {ENC},
z AS (SELECT sum(count) + count(*) AS z FROM vocab),
lp AS (SELECT id, ln((count + 1) / CAST((SELECT z FROM z) AS DOUBLE)) AS lp FROM vocab),
a AS (SELECT doc_id, line_no, id FROM tv UNION ALL SELECT doc_id, line_no, 2 AS id FROM tl)
SELECT doc_id, line_no, round(sum(lp) / count(*), 6) AS score, count(*) AS length FROM a JOIN lp USING (id) GROUP BY ALL"""
ORACLE["scr_06_post_process"] = ORACLE["jn_05_replace_unk"].replace(
    "md5(coalesce(text, '')) AS text_md5, CAST(coalesce(n, 0) AS BIGINT) AS n_replaced",
    "CAST(len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS text_md5")


# --- a stream that stops and goes on ----------------------------------------------------------
#: Part files of a micro-batch: a task each or more, so a batch uses many cores and no task reads a whole arrival.
FILES_A_BATCH = 64


@register("str_05_resume")
def q_resume_stream(spark, sf_dir):
    """Documents arrive in three folders of part files; the encoding stream runs on the first, ends, and a new query with the same
    checkpoint takes up the others.  Its sink holds every line once."""
    folder = scratch_path(spark, "resume")
    vocab = cut_lineage(doc_vocab(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").withColumn("_k", F.expr("abs(doc_id) % 3"))
    for k in range(3):
        docs.where(F.col("_k") == k).drop("_k").write.parquet(f"{folder}/in/documents-{k}.parquet")
        if k != 1:  # the second folder waits for the third
            lines = stm.document_line_stream(spark, f"{folder}/in/*", max_files=FILES_A_BATCH)
            stm.stream_encode(lines, vocab, f"{folder}/out", f"{folder}/ckpt").awaitTermination()
    r = spark.read.parquet(f"{folder}/out")
    return r.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.size("ids").cast("long").alias("n_ids"), F.md5(_ids_str("ids")).alias("ids_md5"))


ORACLE["str_05_resume"] = ORACLE["str_01_stream_encode"]


# --- logs: what the lines must say, straight from the events ------------------------------------
VALUES = """lg AS (SELECT event_id, user_id, ts, event_type, value,
  CASE event_type WHEN 'view' THEN 'train_inner' WHEN 'click' THEN 'train' WHEN 'error' THEN 'valid' WHEN 'signup' THEN 'json' END AS kind FROM events)"""
ORACLE["src_16_read_train_log"] = f"""WITH {VALUES}
SELECT event_id, kind, CASE WHEN kind <> 'json' THEN CAST(user_id % 100 + 1 AS INTEGER) END AS epoch,
       CASE WHEN kind = 'train_inner' THEN event_id END AS step, CASE WHEN kind = 'valid' THEN 'valid' END AS subset,
       round(CASE WHEN kind IN ('train_inner', 'train') THEN CAST(printf('%.3f', value) AS DOUBLE) WHEN kind = 'valid' THEN CAST(printf('%.5f', value) AS DOUBLE) ELSE value END, 5) AS loss,
       round(log2(CASE WHEN kind IN ('train_inner', 'train') THEN CAST(printf('%.2f', pow(2.0::DOUBLE, value / 2)) AS DOUBLE)
                       WHEN kind = 'valid' THEN CAST(printf('%.2f', pow(2.0::DOUBLE, value)) AS DOUBLE) END), 3) AS log2_ppl, event_id AS num_updates
FROM lg WHERE kind IS NOT NULL"""
ORACLE["win_12_running_best"] = f"""WITH {VALUES},
v AS (SELECT user_id, event_id AS num_updates, CAST(printf('%.5f', value) AS DOUBLE) AS loss FROM lg WHERE kind = 'valid'),
b AS (SELECT *, min(loss) OVER (PARTITION BY user_id ORDER BY num_updates ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v)
SELECT user_id, num_updates, round(loss, 5) AS loss, round(least(coalesce(before, loss), loss), 5) AS best_so_far, before IS NULL OR loss < before AS is_best FROM b"""


# --- characters and punctuation ----------------------------------------------------------------
ORACLE["prj_19_words_to_numbers"] = f"""WITH {lines_cte('')},
ctl AS (SELECT doc_id, line_no, list_filter(string_split(regexp_replace(text, '{WS}', '', 'g'), ''), lambda x: x <> '') AS t FROM lines),
ctoks AS (SELECT doc_id, line_no, CAST(unnest(generate_series(0, len(t) - 1)) AS BIGINT) AS pos, unnest(t) AS symbol FROM ctl WHERE len(t) > 0),
{vocab_ctes(-1, -1, padding=1, toks='ctoks', nlines='ctl')},
e AS (SELECT doc_id, line_no, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ' ' ORDER BY pos) AS s FROM ctoks LEFT JOIN vocab v USING (symbol) GROUP BY ALL)
SELECT doc_id, line_no, md5(coalesce(s, '')) AS ids_md5 FROM ctl LEFT JOIN e USING (doc_id, line_no)"""


def _replaced(expr: str) -> str:
    for a, b in PUNCT_REPLACEMENTS:
        a, b = a.replace("'", "''"), b.replace("'", "''")
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


ORACLE["prj_18_normalize_punct"] = f"""WITH {lines_cte('')}
SELECT doc_id, line_no, md5(regexp_replace({_replaced("regexp_replace(text, '[' || chr(92) || 'p{Cc}' || chr(92) || 'p{Cf}' || chr(92) || 'p{Co}]', ' ', 'g')")}, ' +', ' ', 'g')) AS text_md5 FROM lines"""


# --- collated batches ----------------------------------------------------------------------------
ORACLE["bat_02_collate"] = BATCHES + f""",
side AS (SELECT b.*, CASE WHEN r.text IS NULL THEN 1 ELSE len({tok('r.text')}) + 1 END AS p_len
         FROM batched b LEFT JOIN conversations r ON r.conv_id = b.conv_id AND r.turn = b.turn + 2),
own AS (SELECT *, CASE WHEN p_len > 1 THEN tgt_len ELSE 0 END AS m_len FROM side)
SELECT conv_id, turn, batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY src_len DESC, conv_id, turn) - 1 AS INTEGER) AS row_in_batch,
       CAST(max(src_len) OVER w AS BIGINT) AS n_source, CAST(max(tgt_len) OVER w AS BIGINT) AS n_target, CAST(max(tgt_len) OVER w AS BIGINT) AS n_prev_output,
       CAST(max(p_len) OVER w AS BIGINT) AS n_pivot, CAST(max(m_len) OVER w AS BIGINT) AS n_mt,
       CAST(max(src_len) OVER w - src_len AS BIGINT) AS pads_source, CAST(max(tgt_len) OVER w - tgt_len AS BIGINT) AS pads_target,
       CAST(max(p_len) OVER w - p_len AS BIGINT) AS pads_pivot, CAST(max(m_len) OVER w - m_len AS BIGINT) AS pads_mt, 2 AS last_source, 2 AS first_prev
FROM own WINDOW w AS (PARTITION BY batch_id)"""
ORACLE["srt_04_collate_order"] = BATCHES + """
SELECT conv_id, turn, batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY src_len DESC, conv_id, turn) - 1 AS INTEGER) AS row_in_batch,
       CAST(max(src_len) OVER (PARTITION BY batch_id) AS BIGINT) AS padded_src, CAST(max(tgt_len) OVER (PARTITION BY batch_id) AS BIGINT) AS padded_tgt, 2 AS first_prev
FROM batched"""

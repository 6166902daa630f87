"""Word alignments, lexicons and attention tables: SRC-12, JN-04, JN-05, FLT-08, AGG-06, AGG-07,
AGG-32 (intersection/union), WIN-04, WIN-05, JN-10, AGG-20, AGG-28, FLT-10.

Alignment links sit on the pair's row as ``ARRAY<STRUCT<src_pos, tgt_pos>>``: fetching the linked
tokens is ``element_at`` on arrays of the same row, no shuffle.  Attention tables are long form
``(sample, tgt_pos, src_pos, weight)`` holding only non-zero weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqcorpus.constants import EOS, PAD, UNK, UNK_WORD
from seqcorpus.plans.broadcast import maybe_broadcast


def parse_alignment(col) -> F.Column:
    """SRC-12: ``"i-j i-j ..."`` → ``ARRAY<STRUCT<src_pos INT, tgt_pos INT>>``."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.filter(F.split(F.trim(c), " +"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split(x, "-")[0].cast("int").alias("src_pos"),
                                                 F.split(x, "-")[1].cast("int").alias("tgt_pos")))


def link_tokens(pairs: DataFrame, key_cols: list[str], links: str, src_ids: str, tgt_ids: str) -> DataFrame:
    """JN-04: every link fetches (src_id, tgt_id); a link on eos or pad raises."""
    ex = pairs.select(*key_cols, F.posexplode(links).alias("link_no", "l"), src_ids, tgt_ids)
    s = F.element_at(src_ids, F.col("l.src_pos") + 1)
    t = F.element_at(tgt_ids, F.col("l.tgt_pos") + 1)
    bad = s.isin(EOS, PAD) | t.isin(EOS, PAD) | s.isNull() | t.isNull()
    return ex.select(*key_cols, "link_no", F.when(bad, F.raise_error(F.lit("alignment link reaches eos/pad")))
                     .otherwise(s).alias("src_id"), t.alias("tgt_id"))


def known_pairs_only(linked: DataFrame) -> DataFrame:
    """FLT-08: a link counts only if neither side is unk."""
    return linked.filter((F.col("src_id") != UNK) & (F.col("tgt_id") != UNK))


def cooccurrence(linked: DataFrame, order_cols: list[str]) -> DataFrame:
    """AGG-06: count of (src_id, tgt_id) links, with the first link position for tie-breaks."""
    return linked.groupBy("src_id", "tgt_id").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*[F.col(c) for c in order_cols])).alias("first"))


def argmax_lexicon(cooc: DataFrame) -> DataFrame:
    """AGG-07: per source id the most frequent target id; ties to the first seen."""
    w = Window.partitionBy("src_id").orderBy(F.col("cnt").desc(), F.col("first").asc())
    return cooc.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("src_id", "tgt_id", "cnt")


def replace_unk(hyps: DataFrame, key_cols: list[str], hyp_tokens: str, src_tokens: str, alignment: str,
                lexicon: DataFrame) -> DataFrame:
    """JN-05: each '<unk>' hypothesis token → the source word at alignment[pos] (source gets an
    extra '<eos>'), mapped through the lexicon when present, else the source word itself."""
    ex = hyps.select(*key_cols, F.posexplode(hyp_tokens).alias("pos", "tok"), src_tokens, alignment)
    srcw = F.element_at(F.concat(F.col(src_tokens), F.array(F.lit("<eos>"))), F.element_at(alignment, F.col("pos") + 1) + 1)
    ex = ex.withColumn("_src", F.when(F.col("tok") == UNK_WORD, srcw))
    lex = maybe_broadcast(lexicon.select(F.col("src").alias("_src"), F.col("tgt").alias("_lex")))
    j = ex.join(lex, "_src", "left")
    out = j.withColumn("word", F.when(F.col("tok") == UNK_WORD, F.coalesce("_lex", "_src")).otherwise(F.col("tok")))
    return out.groupBy(*key_cols).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"),
        F.sum(F.when(F.col("tok") == UNK_WORD, 1).otherwise(0)).alias("n_replaced"))


def symmetrize(a: str, b: str, how: str = "intersection") -> F.Column:
    """AGG-32 (intersection / union of two link arrays)."""
    return F.array_sort(F.array_intersect(a, b) if how == "intersection" else F.array_union(a, b))


def local_attention(pairs: DataFrame, key_cols: list[str], src_len: str, tgt_len: str, width: int = 2) -> DataFrame:
    """Attention table from normalised position distance: target position t looks at source
    positions around ``round(t * src_len / tgt_len)`` with a triangular kernel of half-width
    ``width``; weights outside are exactly zero and not stored; each row is normalised."""
    centre = F.round(F.col("tgt_pos") * F.col(src_len) / F.col(tgt_len)).cast("int")
    t = pairs.select(*key_cols, src_len, tgt_len, F.explode(F.sequence(F.lit(0), F.col(tgt_len) - 1)).alias("tgt_pos"))
    t = t.withColumn("_c", F.least(centre, F.col(src_len) - 1))
    s = t.select(*key_cols, "tgt_pos", "_c", src_len,
                 F.explode(F.sequence(F.greatest(F.col("_c") - width, F.lit(0)),
                                      F.least(F.col("_c") + width, F.col(src_len) - 1))).alias("src_pos"))
    s = s.withColumn("_w", F.lit(width + 1) - F.abs(F.col("src_pos") - F.col("_c")))
    w = Window.partitionBy(*key_cols, "tgt_pos")
    return s.select(*key_cols, "tgt_pos", "src_pos", (F.col("_w") / F.sum("_w").over(w)).alias("weight"))


def topk_positions(att: DataFrame, key_cols: list[str], k: int) -> DataFrame:
    """WIN-04: the k largest weights per target position, ties by source position."""
    w = Window.partitionBy(*key_cols, "tgt_pos").orderBy(F.col("weight").desc(), F.col("src_pos"))
    return att.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_alignment(att: DataFrame, key_cols: list[str]) -> DataFrame:
    """WIN-05: argmax source position per target position (ties to the smaller position)."""
    return att.groupBy(*key_cols, "tgt_pos").agg(
        F.max_by("src_pos", F.struct("weight", -F.col("src_pos"))).alias("src_pos"))


def attention_relay(att_tp: DataFrame, att_ps: DataFrame, key_cols: list[str], k: int = 3, p: float = 0.3) -> DataFrame:
    """JN-10: target → its top-k pivot positions → each pivot's argmax source position, weight p;
    duplicates collapse to one entry."""
    # a pivot has one hard row at most, so a window on the union of both sides hands its source position to the top rows; unlike a
    # join on the position, it keeps the tables' partitioning by key
    top = topk_positions(att_tp, key_cols, k).select(*key_cols, F.col("src_pos").alias("pivot_pos"), "tgt_pos", F.lit(False).alias("_hard"), F.lit(None).cast("int").alias("_src"))
    hard = hard_alignment(att_ps, key_cols).select(*key_cols, F.col("tgt_pos").alias("pivot_pos"), F.lit(None).cast("int").alias("tgt_pos"), F.lit(True).alias("_hard"), F.col("src_pos").alias("_src"))
    pivot = Window.partitionBy(*key_cols, "pivot_pos")
    both = top.unionByName(hard).dropna(subset=[*key_cols, "pivot_pos"])
    both = both.withColumn("src_pos", F.max("_src").over(pivot)).withColumn("_met", F.max("_hard").over(pivot))
    return both.where("_met AND NOT _hard").select(*key_cols, "tgt_pos", "src_pos").distinct().withColumn("weight", F.lit(p))


def attention_teaching_loss(student: DataFrame, relayed: DataFrame, key_cols: list[str]) -> DataFrame:
    """AGG-20: ``sqrt(sum (student - relayed)^2)`` over the union of both tables' cells."""
    cell = [*key_cols, "tgt_pos", "src_pos"]
    # a cell's rows of both sides meet in a group, which keeps the partitioning by key; a cell with a null in its key meets nothing
    lone = F.lit(False)
    for c in cell:
        lone = lone | F.col(c).isNull()
    weight, none = F.coalesce("weight", F.lit(0.0)).cast("double"), F.lit(None).cast("double")
    sides = [student.select(*cell, weight.alias("s"), none.alias("r"), F.when(lone, 1).otherwise(0).alias("_lone")),
             relayed.select(*cell, none.alias("s"), weight.alias("r"), F.when(lone, 2).otherwise(0).alias("_lone"))]
    met = sides[0].unionByName(sides[1]).groupBy(*cell, "_lone").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("s", "r") for n, f in (("n", F.count), ("avg", F.avg), ("var", F.var_pop))])
    # every row of one side meets every row of the other: sum (s - r)^2 by their means and variances (0 of a single row)
    n = F.greatest("n_s", F.lit(1)) * F.greatest("n_r", F.lit(1))
    d = F.coalesce("avg_s", F.lit(0.0)) - F.coalesce("avg_r", F.lit(0.0))
    return met.agg(F.sqrt(F.sum(n * (d * d + F.coalesce("var_s", F.lit(0.0)) + F.coalesce("var_r", F.lit(0.0))))).alias("loss"))


def head_average(att: DataFrame, key_cols: list[str], head_col: str = "head", n_heads: int | None = None) -> DataFrame:
    """AGG-28: mean attention over heads (a head without the cell counts 0 when n_heads is given)."""
    agg = att.groupBy(*key_cols, "tgt_pos", "src_pos")
    if n_heads:
        return agg.agg((F.sum("weight") / n_heads).alias("weight"))
    return agg.agg(F.avg("weight").alias("weight"))


def mask_source_pad(att: DataFrame, src_ids: DataFrame, key_cols: list[str], pad: int = PAD) -> DataFrame:
    """FLT-10: the attention target is 0 at padded source positions."""
    j = att.join(src_ids.select(*key_cols, "src_pos", "src_id"), [*key_cols, "src_pos"], "left")
    return j.withColumn("weight", F.when(F.col("src_id") == pad, 0.0).otherwise(F.col("weight"))).drop("src_id")

"""Positional pairing of line-aligned corpora: SRC-02, SRC-03, SRC-19, SRC-20, JN-03, JN-12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parallel_read(src: DataFrame, tgt: DataFrame, key_cols: list[str], how: str = "inner",
                  text_col: str = "text") -> DataFrame:
    """SRC-02 / JN-03: pair two corpora by line position.  ``inner`` stops at the shorter side
    (zip); ``outer`` keeps every line with nulls on the missing side (zip_longest)."""
    s = src.select(*key_cols, F.col(text_col).alias("src_text"))
    t = tgt.select(*key_cols, F.col(text_col).alias("tgt_text"))
    return s.join(t, key_cols, "inner" if how == "inner" else "full_outer")


def multiway_read(src: DataFrame, tgt: DataFrame, key_cols: list[str], pivot: DataFrame | None = None,
                  mt: DataFrame | None = None, train: bool = True, text_col: str = "text") -> DataFrame:
    """SRC-03: 3-/4-way positional join.  On the train split pivot/mt are required (inner join and
    equal row counts checked with one aggregate), elsewhere they are optional (left join)."""
    out = parallel_read(src, tgt, key_cols, "inner", text_col)
    for name, part in (("pivot_text", pivot), ("mt_text", mt)):
        if part is None:
            continue
        p = part.select(*key_cols, F.col(text_col).alias(name))
        out = out.join(p, key_cols, "inner" if train else "left")
    if train:
        parts = [x for x in (src, tgt, pivot, mt) if x is not None]
        counts = [x.count() for x in parts]  # scalars
        if len(set(counts)) != 1:
            raise ValueError(f"row counts of the parts differ: {counts}")
    return out


def write_joined(pairs: DataFrame, src_col: str = "src_text", tgt_col: str = "tgt_text") -> DataFrame:
    """SRC-19: ``src ||| tgt`` lines, both sides stripped."""
    return pairs.withColumn("line", F.concat_ws(" ||| ", F.trim(F.coalesce(src_col, F.lit(""))),
                                                F.trim(F.coalesce(tgt_col, F.lit("")))))


def multi_reference(refs: DataFrame, key_cols: list[str], ref_no: str = "ref_no", text_col: str = "text") -> DataFrame:
    """SRC-20: k references per line collected in ``ref_no`` order."""
    return refs.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(ref_no, text_col))), lambda x: x[text_col]).alias("refs"))


def concat_corpora(corpora: list[DataFrame], group_cols: list[str], order_cols: list[str]) -> DataFrame:
    """SET-02: several corpora appended to one per group (language): ``corpus_ord``, and ``line`` that runs on through the corpora of the
    group.  One global numbering; a group's own numbers start where its first row stands (one row a group, joined back)."""
    from seqcorpus.plans.broadcast import maybe_broadcast
    from seqcorpus.plans.index import global_index

    parts = [c.withColumn("corpus_ord", F.lit(i)) for i, c in enumerate(corpora)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    rows = global_index(union, [*group_cols, "corpus_ord", *order_cols], name="_g")
    first = rows.groupBy(*group_cols).agg(F.min("_g").alias("_g0"))
    return rows.join(maybe_broadcast(first), group_cols).withColumn("line", F.col("_g") - F.col("_g0")).drop("_g", "_g0")


def restore_order(df: DataFrame, id_col: str) -> DataFrame:
    """JN-12: results produced in batch order back in input order."""
    return df.orderBy(id_col)

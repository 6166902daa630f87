"""Registered queries of lexical EM and symmetrisation (AGG-31, AGG-32) on turn pairs, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcorpus.operators import lexical_em as em
from seqcorpus.plans.catalog import PAIR_KEY, _aligned_pairs, register
from seqcorpus.plans.oracle import JOINT, ORACLE
from seqcorpus.plans.session import cut_lineage

ROUNDS = 3


def _pair_ids(spark, sf_dir):
    p, _ = _aligned_pairs(spark, sf_dir)
    return cut_lineage(p.select(*PAIR_KEY, "src_ids", "tgt_ids"))


@register("agg_31_lexical_em")
def q_lexical_em(spark, sf_dir):
    """Word translation probabilities after three rounds, the empty word included."""
    model, _ = em.lexical_em(_pair_ids(spark, sf_dir), "src_ids", "tgt_ids", ROUNDS)
    return model.select("src_id", "tgt_id", F.round("prob", 6).alias("prob"))


def _both_links(spark, sf_dir):
    p = _pair_ids(spark, sf_dir)
    forward, _ = em.lexical_em(p, "src_ids", "tgt_ids", ROUNDS)
    backward, _ = em.lexical_em(p, "tgt_ids", "src_ids", ROUNDS)
    turned = F.transform("links", lambda x: F.struct(x["tgt_pos"].alias("src_pos"), x["src_pos"].alias("tgt_pos")))
    there = em.best_links(p, PAIR_KEY, "src_ids", "tgt_ids", forward).withColumnRenamed("links", "forward")
    back = em.best_links(p, PAIR_KEY, "tgt_ids", "src_ids", backward).select(*PAIR_KEY, F.array_sort(turned).alias("backward"))
    return there.join(back, PAIR_KEY)


@register("agg_32_grow_diag_final_and")
def q_grow_diag(spark, sf_dir):
    """Links of both directions by three rounds of EM, symmetrised by grow-diag-final-and."""
    rows = cut_lineage(_both_links(spark, sf_dir)).withColumn("links", em.grow_diag_final_and("forward", "backward"))
    text = F.array_join(F.transform("links", lambda x: F.concat(x["src_pos"].cast("string"), F.lit("-"), x["tgt_pos"].cast("string"))), " ")
    return rows.select(*PAIR_KEY, F.size("forward").cast("long").alias("n_forward"), F.size("backward").cast("long").alias("n_backward"), text.alias("links"))


# --- oracle: each round from the pairs of all positions -------------------------------------
def _round(k: int) -> str:
    if k == 1:
        cells = "SELECT e, f, 1.0::DOUBLE / n AS c FROM cells"
    else:
        cells = f"""SELECT c.e, c.f, m.prob / sum(m.prob) OVER (PARTITION BY c.conv_id, c.turn, c.j) AS c
  FROM cells c JOIN m{k - 1} m ON m.e = c.e AND m.f = c.f"""
    return f""",
c{k} AS (SELECT e, f, sum(c) AS c FROM ({cells}) GROUP BY e, f),
m{k} AS MATERIALIZED (SELECT e, f, c / sum(c) OVER (PARTITION BY e) AS prob FROM c{k})"""


ORACLE["agg_31_lexical_em"] = f"""WITH {JOINT},
ids AS MATERIALIZED (SELECT side, conv_id, turn, pos, CAST(coalesce(v.id, 3) AS INTEGER) AS id FROM jtoks LEFT JOIN j_vocab v USING (symbol)),
es AS (SELECT conv_id, turn, id AS e FROM ids WHERE side = 0 UNION ALL SELECT conv_id, turn, -1 AS e FROM pairs),
ns AS (SELECT conv_id, turn, count(*) AS n FROM es GROUP BY ALL),
fs AS (SELECT conv_id, turn, pos AS j, id AS f FROM ids WHERE side = 1),
cells AS MATERIALIZED (SELECT fs.conv_id, fs.turn, j, f, e, n FROM fs JOIN es ON es.conv_id = fs.conv_id AND es.turn = fs.turn
  JOIN ns ON ns.conv_id = fs.conv_id AND ns.turn = fs.turn){"".join(_round(k) for k in range(1, ROUNDS + 1))}
SELECT e AS src_id, f AS tgt_id, round(prob, 6) AS prob FROM m{ROUNDS}"""

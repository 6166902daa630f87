"""Registered queries of model scoring, beam search and sampling (SCR-01 to SCR-06), each with its DuckDB oracle.

The model is the add-one bigram table of the encoded document lines, log-probabilities cut down to multiples of 2^-20, so
that sums of them are exact and ties are ties in any order of adding.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from seqcorpus.constants import EOS
from seqcorpus.operators import decode as dec
from seqcorpus.operators import encode as enc
from seqcorpus.operators import scoring as sc
from seqcorpus.plans.catalog import LINE_ORDER, R6, doc_vocab, register
from seqcorpus.plans.oracle import ORACLE, scored_ctes
from seqcorpus.plans.session import cut_lineage
from seqcorpus.sources.tables import document_lines

BEAM, MAXLEN = 3, 6
GRID = float(1 << 20)


def _model_and_starts(spark, sf_dir, prefix: int):
    """The transition table, and each document with the first tokens of its first line as prefix."""
    vocab = doc_vocab(spark, sf_dir)
    size = vocab.count()
    lines = cut_lineage(enc.encode_lines(document_lines(spark, sf_dir, cols=()), vocab).select(*LINE_ORDER, "ids"))
    model, _ = sc.bigram_model(sc.positions(lines, LINE_ORDER), size, 1.0)
    model = model.withColumn("lp", F.floor(F.col("lp") * GRID) / GRID)
    words = F.filter(F.slice("ids", 1, prefix), lambda t: t != EOS)
    return dec.Transitions(model), lines.where("line_no = 0").select("doc_id", words.alias("prefix"))


@register("scr_02_beam_step")
def q_beam_step(spark, sf_dir):
    """The open hypotheses of every document after three steps from its first word."""
    model, docs = _model_and_starts(spark, sf_dir, 1)
    state = dec.start(docs, ["doc_id"], "prefix")
    for step in range(3):
        state = cut_lineage(dec.beam_step(state, model, ["doc_id"], step, BEAM, MAXLEN).where("NOT finished"))
    rows = dec.open_beams(state, ["doc_id"], 3)
    return rows.select("doc_id", F.col("slot").cast("int").alias("slot"), F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"),
                       F.round("score", R6).alias("score"))


def _decoded(spark, sf_dir, prefix, **options):
    model, docs = _model_and_starts(spark, sf_dir, prefix)
    rows = dec.beam_decode(docs, model, ["doc_id"], k=BEAM, maxlen=MAXLEN, prefix="prefix", **options)
    return rows.select("doc_id", F.col("rank").cast("int").alias("rank"), F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"),
                       F.round("score", R6).alias("score"))


@register("scr_03_beam_decode")
def q_beam_decode(spark, sf_dir):
    """The three best continuations of every document's first word, length-normalised."""
    return _decoded(spark, sf_dir, 1)


@register("scr_04_prefix_constrained")
def q_prefix(spark, sf_dir):
    """As scr_03 with up to three words given, unnormalised."""
    return _decoded(spark, sf_dir, 3, normalize=False)


@register("scr_05_topk_sample")
def q_sample(spark, sf_dir):
    """Two samples a document from the ten likeliest tokens at temperature 0.7."""
    model, docs = _model_and_starts(spark, sf_dir, 1)
    rows = dec.topk_sample(docs, model, ["doc_id"], n=2, k=10, temperature=0.7, maxlen=MAXLEN, seed=11)
    return rows.select("doc_id", "sample", F.array_join(F.col("tokens").cast("array<string>"), " ").alias("tokens"), F.round("score", R6).alias("score"))


# --- oracles -------------------------------------------------------------------------------
def _model(prefix: int) -> str:
    return f"""{scored_ctes()},
grid AS MATERIALIZED (SELECT CAST(ctx AS INTEGER) AS ctx, CAST(token AS INTEGER) AS token, floor(lp * {GRID}) / {GRID} AS lp FROM model WHERE token <> 1),
top AS MATERIALIZED (SELECT ctx, token, lp FROM grid QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY lp DESC, token) <= {2 * BEAM}),
given AS MATERIALIZED (
  SELECT tl.doc_id, list_filter(list(p.token ORDER BY p.pos), lambda x: x <> 2) AS prefix
  FROM tl LEFT JOIN pos p ON p.doc_id = tl.doc_id AND p.line_no = 0 AND p.pos < {prefix} WHERE tl.line_no = 0 GROUP BY tl.doc_id),
b0 AS (SELECT doc_id, 0 AS slot, 2 AS ctx, CAST([] AS INTEGER[]) AS toks, CAST(0 AS DOUBLE) AS cum FROM given),
d0 AS (SELECT CAST(NULL AS BIGINT) AS doc_id, 0 AS ord, CAST([] AS INTEGER[]) AS toks, CAST(0 AS DOUBLE) AS score WHERE false)"""


def _step(t: int, normalize: bool) -> str:
    """CTEs of one step with early stopping: candidates, what finishes, and what goes on."""
    length = float(t + 1) if normalize else 1.0
    if t < MAXLEN:
        cand = f"""SELECT b.doc_id, b.slot, b.toks, m.token, b.cum + m.lp AS cum FROM b{t} b JOIN given g USING (doc_id) JOIN top m ON m.ctx = b.ctx
  WHERE len(g.prefix) <= {t}
  UNION ALL SELECT b.doc_id, b.slot, b.toks, g.prefix[{t + 1}] AS token, b.cum + coalesce(m.lp, '-inf'::DOUBLE) AS cum
  FROM b{t} b JOIN given g USING (doc_id) LEFT JOIN grid m ON m.ctx = b.ctx AND m.token = g.prefix[{t + 1}] WHERE len(g.prefix) > {t}"""
    else:
        cand = f"""SELECT b.doc_id, b.slot, b.toks, 2 AS token, b.cum + coalesce(m.lp, '-inf'::DOUBLE) AS cum
  FROM b{t} b LEFT JOIN grid m ON m.ctx = b.ctx AND m.token = 2"""
    ends = "token = 2" if t >= 1 else "false"
    return f""",
c{t} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cum DESC, slot, token) AS r FROM ({cand}) QUALIFY r <= {2 * BEAM}),
n{t} AS (SELECT doc_id, count(*) AS n FROM d{t} GROUP BY doc_id),
f{t} AS MATERIALIZED (
  SELECT c.doc_id, coalesce(n.n, 0) + row_number() OVER (PARTITION BY c.doc_id ORDER BY r) AS ord, list_append(toks, token) AS toks, cum / {length} AS score
  FROM c{t} c LEFT JOIN n{t} n ON n.doc_id = c.doc_id WHERE r <= {BEAM} AND {ends} QUALIFY ord <= {BEAM}),
d{t + 1} AS MATERIALIZED (SELECT * FROM d{t} UNION ALL SELECT * FROM f{t}),
full{t} AS (SELECT doc_id FROM d{t + 1} GROUP BY doc_id HAVING count(*) = {BEAM}),
b{t + 1} AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS INTEGER) AS slot, token AS ctx, list_append(toks, token) AS toks, cum
  FROM c{t} WHERE token <> 2 AND cum > '-inf'::DOUBLE AND doc_id NOT IN (SELECT doc_id FROM full{t})
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r) <= {BEAM})"""


def _beam_sql(prefix: int, normalize: bool) -> str:
    return f"""WITH {_model(prefix)}{"".join(_step(t, normalize) for t in range(MAXLEN + 1))}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS INTEGER) AS rank,
       array_to_string(toks, ' ') AS tokens, round(score, 6) AS score FROM d{MAXLEN + 1}"""


ORACLE["scr_03_beam_decode"] = _beam_sql(1, True)
ORACLE["scr_04_prefix_constrained"] = _beam_sql(3, False)
ORACLE["scr_02_beam_step"] = f"""WITH {_model(1)}{"".join(_step(t, True) for t in range(3))}
SELECT doc_id, slot, array_to_string(toks, ' ') AS tokens, round(cum, 6) AS score FROM b3"""


def _sample_step(t: int) -> str:
    u = f"(('0x' || substr(md5('11|' || r.doc_id || '|' || r.sample || '|{t}|' || m.token), 1, 12))::BIGINT + 0.5::DOUBLE) / {float(1 << 48)}"
    return f""",
s{t + 1} AS MATERIALIZED (
  SELECT doc_id, sample, CASE WHEN open AND token IS NOT NULL THEN token ELSE ctx END AS ctx,
         CASE WHEN open AND token IS NOT NULL THEN list_append(toks, token) ELSE toks END AS toks,
         CASE WHEN open AND token IS NOT NULL THEN score + lp ELSE score END AS score, open AND token IS NOT NULL AND token <> 2 AS open
  FROM (SELECT r.*, m.token, m.lp / 0.7::DOUBLE AS lp, m.lp / 0.7::DOUBLE - ln(-ln({u})) AS g FROM s{t} r LEFT JOIN ten m ON m.ctx = r.ctx)
  QUALIFY row_number() OVER (PARTITION BY doc_id, sample ORDER BY g DESC, token) = 1)"""


ORACLE["scr_05_topk_sample"] = f"""WITH {_model(1)},
ten AS MATERIALIZED (SELECT ctx, token, lp FROM grid WHERE token >= 2 QUALIFY row_number() OVER (PARTITION BY ctx ORDER BY lp DESC, token) <= 10),
s0 AS (SELECT doc_id, unnest([0, 1]) AS sample, 2 AS ctx, CAST([] AS INTEGER[]) AS toks, CAST(0 AS DOUBLE) AS score, true AS open FROM given)
{"".join(_sample_step(t) for t in range(MAXLEN))}
SELECT doc_id, sample, array_to_string(toks, ' ') AS tokens, round(score, 6) AS score FROM s{MAXLEN}"""

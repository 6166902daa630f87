"""Beam search and sampling over a next-token table: SCR-02 to SCR-05.

A model is any object with two methods on rows ``(keys..., slot, ctx, tokens, score, ...)``, one a hypothesis:

* ``best(beams, step, width)``: the rows repeated with the ``width`` likeliest next tokens, as ``token`` and ``lp``;
* ``given(beams, step, token)``: the rows with the log-probability ``lp`` of the token in that column.

``Transitions`` is the model of a table ``(ctx, token, lp)`` in which the last token is the context.  Scores add up, so
a context's 2k likeliest tokens hold all that a beam of k can use, and no hypothesis meets more.

The state has a row a sentence: its open hypotheses (at most k) and its finished ones (at most k).  A step explodes the
open ones, joins the model, keeps the 2k best of each sentence by a window limit (map-side first) and brings them
back to the sentence's row, where all bookkeeping is row-local.  Each step is checkpointed; finished sentences leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcorpus.constants import EOS, PAD, UNK
from seqcorpus.plans.broadcast import maybe_broadcast
from seqcorpus.plans.session import cut_lineage

_HYP = "STRUCT<tokens: ARRAY<INT>, cums: ARRAY<DOUBLE>, score: DOUBLE>"
_MINUS_INF = float("-inf")


class Transitions:
    """The model of a table ``(ctx, token, lp)``.  The pad token is never a candidate, ``unk`` costs ``unkpen``."""

    def __init__(self, table: DataFrame, unkpen: float = 0.0, pad: int = PAD, unk: int = UNK):
        lp = F.col("lp") - F.when(F.col("token") == unk, float(unkpen)).otherwise(0.0)
        self.table = cut_lineage(table.where(F.col("token") != pad).select(
            F.col("ctx").cast("int").alias("ctx"), F.col("token").cast("int").alias("token"), lp.alias("lp")))
        self._best: dict[int, DataFrame] = {}
        self._given: DataFrame | None = None

    def listed(self, width: int) -> DataFrame:
        """(ctx, next): the ``width`` likeliest tokens of each context, likeliest first, ties to the smaller id."""
        if width not in self._best:
            w = Window.partitionBy("ctx").orderBy(F.desc("lp"), "token")
            top = self.table.withColumn("r", F.row_number().over(w)).where(F.col("r") <= width)
            nested = top.groupBy("ctx").agg(F.array_sort(F.collect_list(F.struct("r", "token", "lp"))).alias("next"))
            self._best[width] = maybe_broadcast(nested)
        return self._best[width]

    def best(self, beams: DataFrame, step: int, width: int) -> DataFrame:
        rows = beams.join(self.listed(width), "ctx")
        return rows.select(*beams.columns, F.explode("next").alias("_n")).select(*beams.columns, "_n.token", "_n.lp")

    def given(self, beams: DataFrame, step: int, token: str) -> DataFrame:
        if self._given is None:
            self._given = maybe_broadcast(self.table.withColumnRenamed("token", "_token").withColumnRenamed("ctx", "_ctx"))
        on = (F.col("ctx") == F.col("_ctx")) & (F.col(token) == F.col("_token"))
        lp = F.coalesce("lp", F.lit(_MINUS_INF)).alias("lp")
        return beams.join(self._given, on, "left").select(*beams.columns, F.col(token).alias("token"), lp)


def start(sentences: DataFrame, key_cols: list[str], prefix: str | None = None, eos: int = EOS) -> DataFrame:
    """The state before the first step: one open hypothesis without tokens, its context ``eos``."""
    first = F.struct(F.lit(eos).alias("ctx"), F.expr("CAST(array() AS ARRAY<INT>)").alias("tokens"), F.expr("CAST(array() AS ARRAY<DOUBLE>)").alias("cums"))
    forced = F.coalesce(F.col(prefix).cast("array<int>"), F.expr("CAST(array() AS ARRAY<INT>)")) if prefix else F.expr("CAST(array() AS ARRAY<INT>)")
    return sentences.select(*key_cols, forced.alias("prefix"), F.array(first).alias("beams"), F.expr(f"CAST(array() AS ARRAY<{_HYP}>)").alias("done"),
                            F.lit(-1).alias("worst_at"), F.lit(_MINUS_INF).alias("worst"), F.lit(False).alias("finished"))


def open_beams(state: DataFrame, key_cols: list[str], step: int) -> DataFrame:
    """(keys, slot, ctx, tokens, score, forced): a row an open hypothesis; ``forced`` is the prefix's token of this step."""
    rows = state.select(*key_cols, "prefix", F.posexplode("beams").alias("slot", "b"))
    score = F.when(F.size("b.cums") > 0, F.element_at("b.cums", -1)).otherwise(0.0)
    return rows.select(*key_cols, "slot", "b.ctx", "b.tokens", score.alias("score"), F.get("prefix", F.lit(step)).alias("forced"))


def beam_step(state: DataFrame, model, key_cols: list[str], step: int, k: int, maxlen: int, minlen: int = 1, lenpen: float = 1.0,
              normalize: bool = True, stop_early: bool = True, eos: int = EOS) -> DataFrame:
    """SCR-02: one step for all sentences of the state.

    Candidates are hypothesis score + lp; the best 2k of a sentence stay (ties: lower slot, smaller token).  Of the first
    k, those that end in eos finish, from step ``minlen`` on; the first k of the 2k that don't end go on.  At step
    ``maxlen`` every open hypothesis is closed by eos instead.  A sentence with k finished hypotheses is finished,
    or with ``stop_early`` off once the worst of them can't be beaten.  Where the prefix names a token, it alone is a candidate (SCR-04)."""
    beams = open_beams(state, key_cols, step)
    if step < maxlen:
        free = model.best(beams.where("forced IS NULL"), step, 2 * k)
        forced = model.given(beams.where("forced IS NOT NULL"), step, "forced")
        cand = free.unionByName(forced)
    else:
        cand = model.given(beams.withColumn("_eos", F.lit(eos)), step, "_eos").drop("_eos")
    cand = cand.select(*key_cols, "slot", "token", (F.col("score") + F.col("lp")).alias("cum"))
    w = Window.partitionBy(*key_cols).orderBy(F.desc("cum"), "slot", "token")
    kept = cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * k)
    kept = kept.groupBy(*key_cols).agg(F.array_sort(F.collect_list(F.struct("r", "slot", "token", "cum"))).alias("cands"))
    rows = state.join(kept, key_cols, "left").withColumn("cands", F.coalesce("cands", F.expr("CAST(array() AS ARRAY<STRUCT<r: INT, slot: INT, token: INT, cum: DOUBLE>>)")))

    length = F.lit(float((step + 1) ** lenpen)) if normalize else F.lit(1.0)
    ended = F.filter(F.slice("cands", 1, k), lambda c: c["token"] == eos) if step >= min(minlen, maxlen) else F.slice("cands", 1, 0)
    hypothesis = lambda c: F.struct(F.concat(F.col("beams")[c["slot"]]["tokens"], F.array(c["token"])).alias("tokens"),
                                    F.concat(F.col("beams")[c["slot"]]["cums"], F.array(c["cum"])).alias("cums"), (c["cum"] / length).alias("score"))
    rows = rows.withColumn("new", F.transform(ended, hypothesis))
    rows = rows.withColumn("acc", _finalised(k, stop_early))
    best = F.when(F.size("cands") > 0, F.col("cands")[0]["cum"] / F.lit(float(maxlen**lenpen) if normalize else 1.0)).otherwise(F.lit(_MINUS_INF))
    full = (F.size("new") > 0) & (F.size("acc.done") == k) & (F.lit(stop_early or step == maxlen) | (F.col("acc.worst") >= best))
    go_on = F.slice(F.filter("cands", lambda c: (c["token"] != eos) & (c["cum"] > _MINUS_INF)), 1, k)
    beams = F.transform(go_on, lambda c: F.struct(c["token"].alias("ctx"), F.concat(F.col("beams")[c["slot"]]["tokens"], F.array(c["token"])).alias("tokens"),
                                                  F.concat(F.col("beams")[c["slot"]]["cums"], F.array(c["cum"])).alias("cums")))
    beams = beams if step < maxlen else F.slice("beams", 1, 0)
    rows = rows.withColumn("next", beams)
    return rows.select(*key_cols, "prefix", F.col("next").alias("beams"), "acc.done", "acc.worst_at", "acc.worst",
                       (full | (F.size("next") == 0)).alias("finished"))


def _finalised(k: int, stop_early: bool) -> Column:
    """The finished hypotheses after the ``new`` ones: up to k; then, with ``stop_early`` off, a better one takes the
    place of the worst.  The worst is first looked for when a better one comes to k finished ones, and that first one isn't kept."""
    start = F.struct("done", "worst_at", "worst")

    def add(acc: Column, h: Column) -> Column:
        appended = F.struct(F.concat(acc["done"], F.array(h)).alias("done"), acc["worst_at"].alias("worst_at"), acc["worst"].alias("worst"))
        if stop_early:
            return F.when(F.size(acc["done"]) < k, appended).otherwise(acc)
        done = F.transform(acc["done"], lambda x, i: F.when(i == acc["worst_at"], h).otherwise(x))
        scores = F.transform(done, lambda x: x["score"])
        worst = F.array_min(scores)
        replaced = F.struct(done.alias("done"), (F.array_position(scores, worst) - 1).cast("int").alias("worst_at"), worst.alias("worst"))
        return F.when(F.size(acc["done"]) < k, appended).when(h["score"] > acc["worst"], replaced).otherwise(acc)

    return F.aggregate("new", start, add)


def beam_decode(sentences: DataFrame, model, key_cols: list[str], k: int = 5, maxlen: int = 200, minlen: int = 1, lenpen: float = 1.0,
                normalize: bool = True, stop_early: bool = True, prefix: str | None = None, eos: int = EOS) -> DataFrame:
    """SCR-03 (and SCR-04 with the ``prefix`` column): ``(keys, rank, tokens, score, positional)`` for every finished
    hypothesis, best first, equal scores in the order of finishing.  ``score`` is the sum of log-probabilities over length **
    ``lenpen`` (unnormalised: the sum), ``positional`` its parts.  One checkpointed job a step, at most
    ``maxlen`` + 1, over the sentences that are still open.  A forced prefix goes on as one hypothesis."""
    state = cut_lineage(start(sentences, key_cols, prefix, eos))
    left, out = state, None
    for step in range(maxlen + 1):
        state = cut_lineage(beam_step(left, model, key_cols, step, k, maxlen, minlen, lenpen, normalize, stop_early, eos))
        ended = state.where("finished").select(*key_cols, "done")
        out = ended if out is None else out.unionByName(ended)
        left = state.where("NOT finished")
        if left.isEmpty():
            break
    by_score = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["i"] - b["i"])
    numbered = F.transform("done", lambda h, i: F.struct(i.alias("i"), h["score"].alias("score"), h["tokens"].alias("tokens"), h["cums"].alias("cums")))
    rows = out.select(*key_cols, F.posexplode(F.array_sort(numbered, by_score)).alias("r", "h"))
    positional = F.transform("h.cums", lambda c, i: F.when(i > 0, c - F.col("h.cums")[F.greatest(i - 1, F.lit(0))]).otherwise(c))
    return rows.select(*key_cols, (F.col("r") + 1).alias("rank"), "h.tokens", "h.score", positional.alias("positional"))


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns: the same in every run, on every machine."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def topk_sample(sentences: DataFrame, model: Transitions, key_cols: list[str], n: int = 1, k: int = 10, temperature: float = 1.0,
                maxlen: int = 200, seed: int = 0, eos: int = EOS) -> DataFrame:
    """SCR-05: ``(keys, sample, tokens, score)``, ``n`` independent samples a sentence.

    The next token is drawn from the ``k`` likeliest of its context (without the first two ids) with weights exp(lp / temperature), as
    the maximum of lp / temperature + Gumbel noise; the noise comes from a hash of (seed, sentence, sample, step, token), so reruns
    agree.  ``score`` adds up lp / temperature.  A step is a join and row-local work, no shuffle where the model is small enough to
    be broadcast; it is checkpointed every eight steps.  A sample ends at eos, at ``maxlen``, or where the model lists no token."""
    nothing = F.expr("CAST(array() AS ARRAY<INT>)")
    rows = sentences.select(*key_cols, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"), F.lit(eos).alias("ctx"),
                            nothing.alias("tokens"), F.lit(0.0).alias("score"), F.lit(True).alias("open"))
    allowed = Transitions(model.table.where(F.col("token") >= 2)).listed(k)

    def drawn_at(step: int):
        def key(c: Column) -> Column:
            noise = -F.log(-F.log(uniform(F.lit(seed), *[F.col(x) for x in key_cols], F.col("sample"), F.lit(step), c["token"])))
            return F.struct((c["lp"] / temperature + noise).alias("g"), (-c["token"]).alias("t"), (c["lp"] / temperature).alias("lp"))
        return F.array_max(F.transform("next", key))

    for step in range(maxlen):
        met = rows.join(allowed, "ctx", "left").withColumn("_b", drawn_at(step))
        drawn = F.col("open") & F.col("_b").isNotNull()
        token = -F.col("_b.t")
        rows = met.select(*key_cols, "sample", F.when(drawn, token).otherwise(F.col("ctx")).alias("ctx"),
                          F.when(drawn, F.concat("tokens", F.array(token))).otherwise(F.col("tokens")).alias("tokens"),
                          F.when(drawn, F.col("score") + F.col("_b.lp")).otherwise(F.col("score")).alias("score"),
                          (drawn & (token != eos)).alias("open"))
        if step % 8 == 7:
            rows = cut_lineage(rows)
            if rows.where("open").isEmpty():
                break
    return rows.select(*key_cols, "sample", "tokens", "score")

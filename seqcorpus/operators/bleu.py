"""BLEU, multi-reference BLEU and ROUGE on token tables: AGG-08..13, JN-08.

Per-pair statistics are the ten additive BLEU counters.  The clipped n-gram match (JN-08)
explodes both sides' n-grams and aggregates by (pair, n, gram).  Because the explode stays inside
a task, a frame hash-partitioned by the pair key (the output of the pairing join) needs no
further exchange: the (pair, n, gram) and (pair, n) aggregates reuse the pair partitioning, and a
hot n-gram ("of the") is only ever counted inside its pair.  Corpus BLEU is a global sum
(partial + final aggregation) followed by scalar math.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcorpus.constants import EOS_WORD, PAD_WORD, UNK_WORD

# reference unknown words never match: they become a value no tokenised word can hold
UNK_SENTINEL = "\u0001unk"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bleu_side(tokens, is_reference: bool) -> Column:
    """Sentence as the scorer sees it: tokens + end-of-sentence, leading pads removed, trailing
    end-of-sentence/pad removed but never below one token (an empty line counts 1 token);
    reference unknown words replaced so they cannot match."""
    def trimmed(arr):
        at = F.transform(arr, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i")))
        kept = F.filter(at, lambda t: t.x != PAD_WORD)
        first = F.coalesce(F.get(kept, 0).i, F.size(arr) + 1)
        words = F.filter(at, lambda t: ~t.x.isin(EOS_WORD, PAD_WORD))
        last = F.greatest(F.coalesce(F.element_at(F.transform(words, lambda t: t.i), -1), F.lit(0)), first)
        return F.when(F.size(words) > 0, F.slice(arr, first, last - first + 1)).otherwise(F.slice(arr, first, 1))

    # a lambda's variable is computed once a row; an expression inside a lambda is, for every element
    arr = F.transform(F.array(F.concat(_c(tokens), F.array(F.lit(EOS_WORD)))), trimmed)[0]
    if is_reference:
        arr = F.transform(arr, lambda x: F.when(x == UNK_WORD, F.lit(UNK_SENTINEL)).otherwise(x))
    return arr


def ngrams(tokens, n: int) -> Column:
    """All n-grams of a token array as 64-bit hashes of the token slice (as the original scorer
    hashes its n-grams); grouping on a long instead of a string keeps the aggregate cheap."""
    arr = _c(tokens)
    return F.when(F.size(arr) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(arr) - n + 1),
                              lambda i: F.xxhash64(F.slice(arr, i, n)))
                  ).otherwise(F.array().cast("array<bigint>"))


def _tagger(n: int, r: int, h: int):
    def tag(g):
        return F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(r).alias("r"), F.lit(h).alias("h"))
    return tag


def clipped_matches(pairs: DataFrame, key_cols: list[str], ref_col: str, hyp_col: str,
                    max_order: int = 4) -> DataFrame:
    """JN-08: per (pair, n) the multiset intersection size of reference and hypothesis n-grams."""
    # one pass over the pairs: all n-grams of both sides tagged (n, side) in one array, one explode
    tagged = []
    for n in range(1, max_order + 1):
        for col, r, h in ((ref_col, 1, 0), (hyp_col, 0, 1)):
            tagged.append(F.transform(ngrams(col, n), _tagger(n, r, h)))
    allg = pairs.select(*key_cols, F.explode(F.concat(*tagged)).alias("_t")).select(
        *key_cols, "_t.n", "_t.g", "_t.r", "_t.h")
    per_gram = allg.groupBy(*key_cols, "n", "g").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    return per_gram.groupBy(*key_cols, "n").agg(F.sum(F.least("r", "h")).cast("long").alias("match"))


def bleu_stats(pairs: DataFrame, key_cols: list[str], ref_tokens: str, hyp_tokens: str,
               max_order: int = 4) -> DataFrame:
    """AGG-08: ``reflen, predlen, match1..4, count1..4`` per pair.

    ``count_n`` grows by ``max(0, predlen - n + 1)`` even when the reference is shorter than n."""
    prepared = pairs.select(*key_cols, bleu_side(ref_tokens, True).alias("_ref"),
                            bleu_side(hyp_tokens, False).alias("_hyp"))
    lens = prepared.select(*key_cols, F.size("_ref").cast("long").alias("reflen"),
                           F.size("_hyp").cast("long").alias("predlen"))
    m = clipped_matches(prepared, key_cols, "_ref", "_hyp", max_order)
    wide = m.groupBy(*key_cols).pivot("n", list(range(1, max_order + 1))).agg(F.first("match"))
    out = lens.join(wide, key_cols, "left")
    cols = [*key_cols, "reflen", "predlen"]
    for n in range(1, max_order + 1):
        cols.append(F.coalesce(F.col(str(n)), F.lit(0)).cast("long").alias(f"match{n}"))
        cols.append(F.greatest(F.col("predlen") - (n - 1), F.lit(0)).cast("long").alias(f"count{n}"))
    return out.select(*cols)


def _score_cols(reflen, predlen, matches, counts, order: int):
    precs = [F.when(c > 0, m / c).otherwise(F.lit(0.0)) for m, c in zip(matches[:order], counts[:order])]
    any_zero = F.lit(False)
    logsum = F.lit(0.0)
    for p in precs:
        any_zero = any_zero | (p <= 0)
        logsum = logsum + F.log(F.when(p > 0, p))
    brevity = F.least(F.lit(1.0), F.exp(1 - reflen / predlen))
    score = F.when(predlen <= 0, F.lit(None)).when(any_zero, F.lit(0.0)).otherwise(
        brevity * F.exp(logsum / order) * 100)
    return score, brevity, precs


def corpus_bleu(stats: DataFrame, group_cols: list[str] | None = None, order: int = 4,
                one_init: bool = False) -> DataFrame:
    """AGG-09 (+AGG-11 with ``one_init``): sum the counters (per group) and score.

    Returns ``bleu, p1..p4 (percent), bp, ratio, syslen, reflen``.  ``predlen = 0`` gives null
    (the original divides by zero)."""
    group_cols = group_cols or []
    sums = [F.sum(c).cast("long").alias(c) for c in
            ["reflen", "predlen"] + [f"{k}{n}" for n in range(1, 5) for k in ("match", "count")]]
    agg = stats.groupBy(*group_cols).agg(*sums)
    if one_init:
        for n in range(2, 5):
            agg = agg.withColumn(f"match{n}", F.col(f"match{n}") + 1).withColumn(f"count{n}", F.col(f"count{n}") + 1)
    reflen, predlen = F.col("reflen").cast("double"), F.col("predlen").cast("double")
    matches = [F.col(f"match{n}").cast("double") for n in range(1, 5)]
    counts = [F.col(f"count{n}").cast("double") for n in range(1, 5)]
    score, brevity, precs = _score_cols(reflen, predlen, matches, counts, order)
    return agg.select(*group_cols,
                      F.round(score, 6).alias("bleu"),
                      *[F.round(p * 100, 6).alias(f"p{i + 1}") for i, p in enumerate(precs)],
                      F.round(F.when(predlen > 0, brevity), 6).alias("bp"),
                      F.round(F.when(reflen > 0, predlen / reflen), 6).alias("ratio"),
                      F.col("predlen").alias("syslen"), F.col("reflen").alias("reflen"))


def sentence_bleu(stats: DataFrame, key_cols: list[str], order: int = 4) -> DataFrame:
    """AGG-11: per-pair BLEU with counters started at 1/1 for n = 2..4 (no shuffle)."""
    m = [F.col(f"match{n}").cast("double") + (1 if n > 1 else 0) for n in range(1, 5)]
    c = [F.col(f"count{n}").cast("double") + (1 if n > 1 else 0) for n in range(1, 5)]
    score, _, _ = _score_cols(F.col("reflen").cast("double"), F.col("predlen").cast("double"), m, c, order)
    return stats.select(*key_cols, F.round(score, 6).alias("bleu"))


def bleu_report(scores: DataFrame, order: int = 4) -> DataFrame:
    """AGG-10: ``BLEU4 = 40.83, 67.5/46.9/34.4/25.5 (BP=1.000, ratio=1.006, syslen=…, reflen=…)``."""
    fmt = "BLEU%d = %.2f, " + "/".join(["%.1f"] * order) + " (BP=%.3f, ratio=%.3f, syslen=%d, reflen=%d)"
    return scores.select(F.format_string(fmt, F.lit(order), "bleu", *[f"p{i}" for i in range(1, order + 1)],
                                         "bp", "ratio", "syslen", "reflen").alias("report"))


def multi_ref_bleu(hyps: DataFrame, refs: DataFrame, key_cols: list[str], hyp_tokens: str, ref_tokens: str,
                   ref_no: str = "ref_no", max_order: int = 4, lowercase: bool = True, tasks: int | None = None) -> DataFrame:
    """AGG-12: corpus BLEU against k references: a hypothesis n-gram is clipped by its largest
    count over the references; the reference length is the closest one (shorter wins ties).

    Both inputs are keyed by the pair; all per-pair work aggregates inside the pair key, over ``tasks`` tasks if given."""
    low = (lambda c: F.transform(F.col(c), lambda x: F.lower(x))) if lowercase else (lambda c: F.col(c))
    h = hyps.select(*key_cols, low(hyp_tokens).alias("_h"))
    r = refs.select(*key_cols, ref_no, low(ref_tokens).alias("_r"))
    hyp_len = h.select(*key_cols, F.size("_h").alias("predlen"))
    ref_len = r.select(*key_cols, F.size("_r").alias("_rl"))
    closest = (ref_len.join(hyp_len, key_cols)
               .groupBy(*key_cols)
               .agg(F.min_by("_rl", F.struct(F.abs(F.col("_rl") - F.col("predlen")), F.col("_rl"))).alias("reflen")))
    # all sentences of a pair meet in one task by the pair key; hypotheses and references are told apart by groupings, not by a
    # join on (pair, gram), which would shuffle the n-grams
    sides = r.select(*key_cols, F.lit(False).alias("_is_hyp"), F.col(ref_no).alias("_no"), F.col("_r").alias("_t"))
    sides = h.select(*key_cols, F.lit(True).alias("_is_hyp"), F.lit(None).cast(sides.schema["_no"].dataType).alias("_no"), F.col("_h").alias("_t")).unionByName(sides)
    sides = sides.repartition(tasks, *key_cols) if tasks else sides.repartition(*key_cols)
    tagged = [F.transform(ngrams("_t", n), _tagger(n, 0, 0)) for n in range(1, max_order + 1)]
    grams = sides.select(*key_cols, "_is_hyp", "_no", F.explode(F.concat(*tagged)).alias("_g")).select(*key_cols, "_is_hyp", "_no", "_g.n", "_g.g")
    counts = (grams.groupBy(*key_cols, "n", "g", "_is_hyp", "_no").agg(F.count(F.lit(1)).alias("c"))
              .groupBy(*key_cols, "n", "g").agg(F.sum(F.when(F.col("_is_hyp"), F.col("c"))).alias("hc"),
                                                F.max(F.when(~F.col("_is_hyp"), F.col("c"))).alias("rc")))
    sums = []
    for n in range(1, max_order + 1):
        sums += [F.sum(F.when(F.col("n") == n, F.least("hc", F.coalesce("rc", F.lit(0))))).alias(f"match{n}"),
                 F.sum(F.when(F.col("n") == n, F.col("hc"))).alias(f"count{n}")]
    matches = counts.where("hc IS NOT NULL").groupBy(*key_cols).agg(*sums)
    stats = hyp_len.join(closest, key_cols, "left").join(matches, key_cols, "left")
    cols = [*key_cols, F.coalesce("reflen", F.lit(0)).cast("long").alias("reflen"),
            F.col("predlen").cast("long").alias("predlen")]
    for n in range(1, max_order + 1):
        cols += [F.coalesce(f"match{n}", F.lit(0)).cast("long").alias(f"match{n}"),
                 F.coalesce(f"count{n}", F.lit(0)).cast("long").alias(f"count{n}")]
    return stats.select(*cols)


def rouge_n(pairs: DataFrame, key_cols: list[str], ref_tokens: str, hyp_tokens: str, n: int) -> DataFrame:
    """AGG-13 (n-gram part): per pair recall/precision/F1 of clipped n-gram overlap."""
    p = pairs.select(*key_cols, F.col(ref_tokens).alias("_r"), F.col(hyp_tokens).alias("_h"))
    m = clipped_matches(p, key_cols, "_r", "_h", n).filter(F.col("n") == n)
    base = p.select(*key_cols, F.greatest(F.size("_r") - (n - 1), F.lit(0)).alias("rn"),
                    F.greatest(F.size("_h") - (n - 1), F.lit(0)).alias("hn"))
    j = base.join(m.select(*key_cols, "match"), key_cols, "left").fillna(0, ["match"])
    rec = F.when(F.col("rn") > 0, F.col("match") / F.col("rn")).otherwise(0.0)
    prec = F.when(F.col("hn") > 0, F.col("match") / F.col("hn")).otherwise(0.0)
    f1 = F.when(rec + prec > 0, 2 * rec * prec / (rec + prec)).otherwise(0.0)
    return j.select(*key_cols, rec.alias("recall"), prec.alias("precision"), f1.alias("f1"))


def lcs_length_udf():
    """Row-local longest-common-subsequence length, Arrow-batched: the places of one side are the bits of a number, so a
    word of the other side costs a few operations on it; the only per-row Python in the scorer."""

    def length(x, y) -> int:
        places: dict = {}
        for j, word in enumerate(y):
            places[word] = places.get(word, 0) | 1 << j
        full = free = (1 << len(y)) - 1  # a bit that is off: the subsequence grows at this place
        for word in x:
            met = free & places.get(word, 0)
            free = ((free + met) | (free - met)) & full
        return len(y) - free.bit_count()

    @F.pandas_udf("int")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None or y is None else length(x, y) for x, y in zip(a, b)], dtype="int32")
    return lcs


def rouge_l(pairs: DataFrame, key_cols: list[str], ref_tokens: str, hyp_tokens: str) -> DataFrame:
    """AGG-13 (LCS part): per pair recall/precision/F1 of the longest common subsequence."""
    lcs = lcs_length_udf()
    p = pairs.select(*key_cols, F.size(ref_tokens).alias("rn"), F.size(hyp_tokens).alias("hn"),
                     lcs(F.col(ref_tokens), F.col(hyp_tokens)).alias("lcs"))
    rec = F.when(F.col("rn") > 0, F.col("lcs") / F.col("rn")).otherwise(0.0)
    prec = F.when(F.col("hn") > 0, F.col("lcs") / F.col("hn")).otherwise(0.0)
    f1 = F.when(rec + prec > 0, 2 * rec * prec / (rec + prec)).otherwise(0.0)
    return p.select(*key_cols, "lcs", rec.alias("recall"), prec.alias("precision"), f1.alias("f1"))

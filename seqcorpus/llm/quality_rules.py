"""Quality rules as a learned decision list, in DataFrame functions alone (operator 6).

:func:`statistics` counts words, symbols, repeated lines and repeated words of each whole text with array
functions inside the row: no explode, no shuffle.  :func:`learn` fits a decision list for "reject" by
sequential covering on labelled rows: a conjunction of thresholds grows while it gains (FOIL gain), is
pruned on held-out rows, is kept if it is precise there, and the rows that it covers go before the next is
grown.  Each step is one aggregation over binned statistics; the driver sees a count per statistic and
bin.  :func:`verdict` is the list as one ordered CASE WHEN expression.

The labelled rows used are bounded by ``sample_rows`` (the smallest hashes of doc_id).  Defined cases: a null
or empty text has zero words and fails the base rule; a text of fewer than five words repeats none; no
labelled rows, or none of one class, give an empty list, which keeps all that pass the base rule; null
labels are left out; repeated rows are judged alike; an empty table gives an empty result; extra columns
pass through :func:`apply_rules` untouched (its own working columns start with ``_q``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcorpus.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
BINS = 20

FEATURES = {
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "words": "cast(n_words as double)",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row (lambdas would compute it for each element)."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of five found twice or more, the first finding included."""

    def marked(s):  # s: windows sorted by (hash, place); places whose hash has an equal neighbour
        twin = lambda x, k: F.when((k > 0) & (F.get(s, k - 1).h == x.h) | (F.get(s, k + 1).h == x.h), x.i)
        places = F.array_sort(F.filter(F.transform(s, twin), lambda p: p.isNotNull()))
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        add = lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n"))
        return F.aggregate(places, zero, add, lambda a: a.n)

    def of_windows(h):
        pairs = lambda: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs(), marked))

    window = lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)])
    windows = F.transform(F.slice(words, 1, F.size(words) - (WINDOW - 1)), window)
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(windows, of_windows))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts as long columns (see the module text)."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACES), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    without = lambda chars: F.length(body) - F.length(F.translate(body, chars, ""))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"),
                                           F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars"),
                                           _repeated(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    out = docs.withColumn("_qc", counts).withColumn("_ql", by_line).withColumns({
        "_qs": without(SYMBOLS), "_qu": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")})
    new = {"n_words": "_qc.n_words", "word_chars": "_qc.word_chars", "n_symbols": "_qs", "n_dup_lines": "_ql.n_dup_lines",
           "n_repeat_words": "_qc.n_repeat_words", "n_distinct": "_qc.n_distinct", "n_lines": "_ql.n_lines",
           "n_upper": "_qu"}
    return out.withColumns({k: F.col(v).cast("long") for k, v in new.items()}).drop("_qc", "_ql", "_qs", "_qu")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(f"CASE WHEN n_words > 0 THEN {FEATURES[self.feature]} ELSE 0 END")
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def __str__(self):
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """The decision list: rejected (false) by the first rule that covers the row, else kept."""
    case = None
    for rule in rules:
        case = F.when(covers(rule), False) if case is None else case.when(covers(rule), False)
    return F.lit(True) if case is None else case.otherwise(True)


def _tally(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Counts of (reject, keep) rows by statistic and bin: one aggregation, at most BINS + 1 rows each."""
    bins = [F.struct(F.lit(f).alias("f"), sum((F.col(f"_f_{f}") >= F.lit(t)).cast("int") for t in ts).alias("b")) for f, ts in cuts.items() if ts]
    if not bins:
        return {}
    got = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(
        F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    out: dict = {}
    for r in got:
        out.setdefault(r.f, {})[r.b] = (r.p, r.n)
    return out


def _best(tally: dict, cuts: dict[str, list[float]], p0: int, n0: int) -> Condition | None:
    """The condition of the greatest FOIL gain over the rows tallied."""
    before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
    for f in sorted(tally):
        for k in range(1, len(cuts[f]) + 1):
            up = [sum(v[j] for b, v in tally[f].items() if b >= k) for j in (0, 1)]
            for at_least, (p, n) in ((True, up), (False, (p0 - up[0], n0 - up[1]))):
                if p:
                    gain = p * (math.log2(p / (p + n)) - before)
                    if gain > best[0]:
                        best = (gain, Condition(f, at_least, cuts[f][k - 1]))
    return best[1]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, max_rules: int = 8, max_conditions: int = 3,
          min_precision: float = 0.97, min_cover: int = 5) -> list[Rule]:
    """A decision list for reject (quality 0) from ``docs`` and their ``labels`` (doc_id, quality).

    Only the statistics of the labelled sample are computed here; its ids are broadcast (``sample_rows``
    bounds them) and filter the scan of the texts."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    value = lambda e: F.expr(f"CASE WHEN n_words > 0 THEN {e} ELSE 0 END").cast("double")
    sample = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    # written before the filter, which would else be moved below the join, to all documents
    rows = written(sample.select(base_failed().alias("failed"), F.xxhash64("doc_id").alias("_h"), (1 - F.col("_quality")).cast("int").alias("bad"),
        *[value(e).alias(f"_f_{f}") for f, e in FEATURES.items()]), "labelled").where("NOT failed")
    held = F.pmod("_h", F.lit(3)) == 0
    quantiles = [(k + 1) / (BINS + 1) for k in range(BINS)]
    # thresholds from the rejected rows, their least value included, and from all rows
    marks = rows.agg(*[F.percentile_approx(f"_f_{f}", quantiles, 1000).alias(f) for f in FEATURES],
                     *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(f"_f_{f}")), [0.0, *quantiles], 1000).alias(f"bad_{f}") for f in FEATURES]).first()
    cuts = {f: sorted({*(marks[f] or []), *(marks[f"bad_{f}"] or [])}) for f in FEATURES}

    def column(rule):
        out = F.lit(True)
        for c in rule:
            x = F.col(f"_f_{c.feature}")
            out = out & (x >= F.lit(c.threshold) if c.at_least else x < F.lit(c.threshold))
        return out

    def counts(df, rules):
        got = df.agg(*[F.coalesce(F.sum(F.when(column(r), x)), F.lit(0)).alias(f"{k}{i}") for i, r in enumerate(rules) for k, x in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        return [(got[f"p{i}"], got[f"n{i}"]) for i in range(len(rules))]

    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules:
        grow, prune = left.where(~held), left.where(held)
        rule: Rule = ()
        while len(rule) < max_conditions:
            tally = _tally(grow.where(column(rule)), cuts)
            p, n = map(sum, zip(*next(iter(tally.values())).values(), strict=True)) if tally else (0, 0)
            if not p or not n:
                break
            best = _best(tally, cuts, p, n)
            if best is None:
                break
            rule = (*rule, best)
        if not rule:
            break
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        seen = counts(prune, shorter)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in seen]
        at = max(range(len(shorter)), key=lambda k: (worth[k], -k))
        p, n = seen[at]
        if p < min_cover or p < min_precision * (p + n):
            break
        rules.append(shorter[at])
        left = left.where(~column(shorter[at]))
    return rules


def apply_rules(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed`` and ``kept``."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))

"""Temperature mixing of sources by DataFrame functions (operator 10).

A source's share of the tokens (words plus one per document) is raised to an exponent between 0 and 1 and
normalised.  The exponent is found by repeated interval division: the largest at which the entropy of the
weights reaches ``target_entropy`` (as a part of the greatest possible one), raised where a source would be
repeated more than ``max_repeats`` times.  The token budget is the smallest at which the largest source is
seen whole, so no document is dropped: a source gets epochs = (T / T_max) ** (exponent - 1) >= 1, each
whole epoch a new hash permutation of its documents, the last, part one a permutation's prefix of as many
tokens as are left.  The mixed stream is cut into blocks of ``block_tokens``; each source places its
documents evenly along the stream, and a block's documents are permuted by hash.

Prefix sums never put a source in one task: hashes fall into equal ranges (one per ``block_tokens`` of the
source), ranges are summed first, and only one range's rows are ever ordered together.  Texts are not
shuffled: a document's copies follow from its own hash and its source's line in the plan.

Defined cases: a null source is a source of its own; a null or empty text counts one token; repeated rows
(same id and text) are taken alike, and are copies of one another; an empty table gives an empty result;
one source alone is seen once; extra columns pass through :func:`mixed` (working columns start with
``_m``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqcorpus.llm.common import written

GRID = 64
SPAN = float(1 << 62)
#: Documents hash to 0..2^62-1; the copy number is part of the hash.


def tokens(text: str = "text") -> Column:
    return (F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def place(copy, seed: int, doc_id: str = "doc_id", body: str = "_mcrc") -> Column:
    """Where a document stands in its source's permutation number ``copy``."""
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.col(body), F.lit(seed), copy), 2)


def weights_at(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy (as a part of the greatest) and largest number of repeats at each exponent: one job."""
    grid = sources.select("_mr", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    x = F.pow("_mr", F.col("a"))
    got = grid.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("z"), F.sum(x * F.log("_mr")).alias("xl"),
                                F.max(F.pow("_mr", F.col("a") - 1)).alias("rep")).collect()
    return {r.a: ((math.log(r.z) - r.a * r.xl / r.z) / math.log(r.n) if r.n > 1 else 1.0, r.rep) for r in got}


def _divide(sources: DataFrame, holds, rounds: int = 4) -> float:
    """The largest exponent in [0, 1] for which ``holds`` (true below some exponent, false above)."""
    low, high = 0.0, 1.0
    for _ in range(rounds):
        points = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        got = weights_at(sources, points)
        good = [a for a in points if a in got and holds(*got[a])]
        low = max(good, default=low)
        high = min([a for a in points if a > low], default=low)
        if high == low:
            break
    return low


def plan(keys: DataFrame, target_entropy: float, max_repeats: float, block_tokens: int, seed: int) -> tuple[DataFrame, float]:
    """A row a source: tokens, epochs, quota, width of its hash ranges and the last hash of its part epoch;
    and the exponent.  ``keys`` has _msource, _mtokens, doc_id and _mcrc."""
    totals = written(keys.groupBy("_msource").agg(F.sum("_mtokens").alias("_mT")), "source-totals")
    largest = totals.agg(F.max("_mT")).first()[0] or 1
    sources = totals.withColumn("_mr", F.col("_mT") / F.lit(largest))
    exponent = _divide(sources, lambda entropy, rep: entropy >= target_entropy)
    if weights_at(sources, [exponent]).get(exponent, (1.0, 1.0))[1] > max_repeats:
        exponent = 1.0 - _divide_up(sources, max_repeats)
    sources = sources.withColumn("_mepochs", F.pow("_mr", F.lit(exponent - 1.0))).withColumns({
        "_mfull": F.floor(F.col("_mepochs") + 1e-9).cast("int"),
        "_mwidth": F.ceil(F.lit(SPAN) / F.greatest(F.lit(1), F.ceil(F.col("_mT") / block_tokens))).cast("long")})
    sources = sources.withColumn("_mpart", F.greatest(F.lit(0.0), F.col("_mepochs") - F.col("_mfull")) * F.col("_mT"))
    sources = sources.withColumn("_mpart", F.when(F.col("_mpart") < 1e-6 * F.col("_mT"), 0.0).otherwise(F.col("_mpart")))
    at = keys.join(sources.where("_mpart > 0").select("_msource", "_mfull", "_mwidth", "_mpart"), "_msource")
    at = at.select("_msource", "_mpart", "_mtokens", place(F.col("_mfull"), seed).alias("_mu"), "_mwidth").withColumn("_mk", F.expr("_mu div _mwidth"))
    ranges = at.groupBy("_msource", "_mk").agg(F.sum("_mtokens").alias("_ms"), F.first("_mpart").alias("_mpart"))
    before = Window.partitionBy("_msource").orderBy("_mk").rowsBetween(Window.unboundedPreceding, -1)
    edge = ranges.withColumn("_mb", F.coalesce(F.sum("_ms").over(before), F.lit(0))).where("_mb < _mpart AND _mb + _ms >= _mpart")
    inside = at.drop("_mpart").join(edge.select("_msource", "_mk", "_mb", "_mpart"), ["_msource", "_mk"])
    upto = Window.partitionBy("_msource", "_mk").orderBy("_mu").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("_mc", F.col("_mb") + F.sum("_mtokens").over(upto) - F.col("_mtokens"))
    last = last.where("_mc < _mpart").groupBy("_msource").agg(F.max("_mu").alias("_mlast"))
    out = sources.join(last, "_msource", "left").withColumn("_mlast", F.coalesce("_mlast", F.lit(-1)))
    return written(out, "mixing-plan"), exponent


def _divide_up(sources: DataFrame, max_repeats: float) -> float:
    """The largest distance from exponent 1 at which no source is repeated more than ``max_repeats`` times."""
    low, high = 0.0, 1.0
    for _ in range(4):
        points = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        got = weights_at(sources, [1.0 - d for d in points])
        low = max([d for d in points if got.get(1.0 - d, (0, 0))[1] <= max_repeats], default=low)
        high = min([d for d in points if d > low], default=low)
        if high == low:
            break
    return low


def _tagged(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """Working columns; a source's name becomes a key without nulls."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"_msource": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")),
                             "_mtokens": tokens(text), "_mcrc": F.crc32(F.encode(body, "UTF-8"))})


def _copies(tagged: DataFrame, sources: DataFrame, seed: int, doc_id: str = "doc_id") -> DataFrame:
    """A row for each copy, numbered from 0 in ``copy``."""
    joined = tagged.join(sources, "_msource")
    more = (place(F.col("_mfull"), seed, doc_id) <= F.col("_mlast")).cast("int")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_mfull") - 1 + more)))


def mixed(docs: DataFrame, target_entropy: float = 0.9, max_repeats: float = 4.0, block_tokens: int = 1 << 20,
          seed: int = 10, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents of the mixed stream: each at least once, those of smaller sources more often."""
    keys = written(_tagged(docs, doc_id, source, text).select(F.col(doc_id).alias("doc_id"), "_msource", "_mtokens", "_mcrc"), "mixing-keys")
    sources, _ = plan(keys, target_entropy, max_repeats, block_tokens, seed)
    return _copies(_tagged(docs, doc_id, source, text), sources, seed, doc_id).select(*docs.columns)


def stream(docs: DataFrame, target_entropy: float = 0.9, max_repeats: float = 4.0, block_tokens: int = 1 << 20,
           seed: int = 10, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed stream itself: doc_id, source, tokens, copy, weight of the source, block and slot."""
    tagged = _tagged(docs, doc_id, source, text).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), "_msource", "_mtokens", "_mcrc")
    keys = written(tagged, "mixing-keys")
    sources, _ = plan(keys, target_entropy, max_repeats, block_tokens, seed)
    budget = sources.agg(F.sum(F.col("_mepochs") * F.col("_mT"))).first()[0] or 1.0
    blocks = max(1, math.ceil(budget / block_tokens))
    rows = _copies(keys, sources, seed).withColumn("_mu", place(F.col("copy"), seed)).withColumn("_mk", F.expr("_mu div _mwidth"))
    group = ["_msource", "copy", "_mk"]
    sums = rows.groupBy(*group).agg(F.sum("_mtokens").alias("_ms"))
    before = Window.partitionBy("_msource", "copy").orderBy("_mk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, F.coalesce(F.sum("_ms").over(before), F.lit(0)).alias("_mb"))
    within = Window.partitionBy(*group).orderBy("_mu", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_mc", F.coalesce(F.sum("_mtokens").over(within), F.lit(0))).join(sums, group)
    # the quota is full epochs and what the part epoch really holds, so progress stays below 1
    done = (F.col("copy") * F.col("_mT") + F.col("_mb") + F.col("_mc")) / (F.col("_mepochs") * F.col("_mT"))
    placed = placed.withColumn("block", F.least(F.floor(done * blocks), F.lit(blocks - 1)).cast("long"))
    order = Window.partitionBy("block").orderBy(F.xxhash64("_mu", F.lit(seed)), "doc_id", "copy")
    return placed.select("doc_id", "source", F.col("_mtokens").alias("tokens"), F.col("copy").cast("int").alias("copy"),
                         (F.col("_mepochs") * F.col("_mT") / F.lit(budget)).alias("weight"), "block",
                         (F.row_number().over(order) - 1).cast("long").alias("slot"))

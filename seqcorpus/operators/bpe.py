"""Subword learning and application: AGG-30 (learn merges), PRJ-22 (apply merges).

Learning works on the word-type table ``(freq, syms)`` - far fewer rows than tokens - and on a table of adjacent symbol
pairs with their counts.  A job takes several merges at once: the driver reads the most frequent pairs (``TOP`` rows) and
takes the longest run of them that one-by-one learning would take too (``safe_run``).  The words that contain a merged pair are
rewritten, and the pair table changes by the difference of their pairs before and after; other words are not counted again.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcorpus.constants import BPE_MARKER
from seqcorpus.plans.session import cut_lineage

END = "</w>"
#: Pairs that the driver reads for a job, and merges that a job takes at most.
TOP = 512
RUN = 64


def _initial(words: DataFrame) -> DataFrame:
    chars = F.filter(F.split("word", ""), lambda x: x != "")
    syms = F.concat(F.slice(chars, 1, F.size(chars) - 1),
                    F.array(F.concat(F.element_at(chars, -1), F.lit(END))))
    return words.select(F.col("freq").cast("long").alias("freq"), syms.alias("syms"))


def _adjacent(syms: str) -> Column:
    """The pairs of neighbours in an array of symbols."""
    return F.transform(F.slice(syms, 1, F.greatest(F.size(syms) - 1, F.lit(0))),
                       lambda x, i: F.struct(x.alias("a"), F.get(F.col(syms), i + 1).alias("b")))


def _merged(syms: str, merges: list[tuple[str, str]]) -> Column:
    """Every given pair replaced by its join, from left to right.  No two of the pairs can overlap in a word."""
    known = F.from_json(F.lit(json.dumps({f"{a} {b}": a + b for a, b in merges})), "map<string,string>")
    nothing = F.expr("CAST(array() AS ARRAY<STRING>)")

    def add(done: Column, x: Column) -> Column:
        joined = F.try_element_at(known, F.concat_ws(" ", F.element_at(done, -1), x))
        appended = F.concat(done, F.array(x))
        return F.when(F.size(done) == 0, appended).when(joined.isNotNull(), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(appended)

    return F.aggregate(syms, nothing, add)


def safe_run(top: list[tuple[str, str, int]], complete: bool, made: set[str], limit: int) -> list[tuple[str, str, int]]:
    """The longest run of ``top`` (pairs by count, then symbols, falling) that one-by-one learning takes in that order.

    A merge changes only pairs that share its symbols at the seam, and makes pairs that occur no more often than those did.
    So the next pair is safe if no taken pair overlaps it and it occurs more often than every pair at the seam of a taken one
    that is still to come.  A pair of equal symbols, or one that makes a symbol that exists already, goes alone.
    ``complete`` tells whether ``top`` holds all pairs; if not, pairs as rare as its last one are not safe."""
    taken: list[tuple[str, str, int]] = []
    for a, b, n in top[:limit]:
        if n < 2:
            break
        joined = a + b
        alone = a == b or joined in made or (joined.endswith(END) and len(joined) == len(END) + 1)
        if taken:
            if alone or any(b == c or a == d or joined == c + d for c, d, _ in taken) or (not complete and n == top[-1][2]):
                break
            if any(y == c or x == d for x, y, m in top if m == n for c, d, _ in taken):
                break
        taken.append((a, b, n))
        if alone:
            break
    return taken


def learn_bpe(words: DataFrame, n_merges: int, top: int = TOP) -> DataFrame:
    """AGG-30: ``(rank, left, right)`` merges, most frequent adjacent pair first, ties to the larger pair; a pair that
    occurs once is not merged."""
    spark = words.sparkSession
    cur = cut_lineage(_initial(words.filter(F.length("word") > 0)))
    counted = cur.select("freq", F.explode(_adjacent("syms")).alias("p"))
    pairs = cut_lineage(counted.groupBy("p.a", "p.b").agg(F.sum("freq").alias("n")))
    merges: list[tuple[str, str]] = []
    made: set[str] = set()
    while len(merges) < n_merges:
        first = [tuple(r) for r in pairs.orderBy(F.desc("n"), F.desc("a"), F.desc("b")).limit(top).collect()]
        run = safe_run(first, len(first) < top, made, min(RUN, n_merges - len(merges)))
        if not run:
            break
        merges += [(a, b) for a, b, _ in run]
        made |= {a + b for a, b, _ in run}
        cur = cut_lineage(cur.withColumn("old", F.col("syms")).withColumn("syms", _merged("syms", [(a, b) for a, b, _ in run])))
        touched = cur.where(F.size("syms") < F.size("old"))
        gone = touched.select((-F.col("freq")).alias("n"), F.explode(_adjacent("old")).alias("p"))
        come = touched.select(F.col("freq").alias("n"), F.explode(_adjacent("syms")).alias("p"))
        change = gone.unionByName(come).select("p.a", "p.b", "n")
        pairs = cut_lineage(pairs.unionByName(change).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0"))
        cur = cur.drop("old")
    return spark.createDataFrame([(r, a, b) for r, (a, b) in enumerate(merges)], "rank int, left string, right string")


def apply_bpe_udf(merges: list[tuple[int, str, str]]):
    """PRJ-22: greedy lowest-rank merge per word, pieces joined by '@@ ' (Arrow-batched, applied
    to distinct words only)."""
    ranks = {(a, b): r for r, a, b in merges}

    def segment(word: str) -> str:
        if not word:
            return word
        syms = list(word[:-1]) + [word[-1] + END]
        while len(syms) > 1:
            found = [(ranks[pair], pair) for pair in zip(syms, syms[1:]) if pair in ranks]
            if not found:
                break
            a, b = min(found)[1]
            out, i = [], 0
            while i < len(syms):
                if i < len(syms) - 1 and syms[i] == a and syms[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            syms = out
        syms[-1] = syms[-1][: -len(END)] if syms[-1].endswith(END) else syms[-1]
        syms = [s for s in syms if s]
        return (BPE_MARKER + " ").join(syms)

    @F.pandas_udf("string")
    def bpe(words: pd.Series) -> pd.Series:
        return words.map(segment)

    return bpe


def apply_bpe(tokens: DataFrame, merges: DataFrame, word_col: str = "symbol") -> DataFrame:
    """Segment the distinct words once and join the pieces back to every occurrence."""
    m = [(r[0], r[1], r[2]) for r in merges.orderBy("rank").collect()]  # bounded by n_merges
    udf = apply_bpe_udf(m)
    distinct = tokens.select(word_col).distinct()
    seg = distinct.select(word_col, udf(F.col(word_col)).alias("pieces"))
    return tokens.join(seg, word_col, "left")

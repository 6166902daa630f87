"""Word alignment by expectation maximisation and its symmetrisation: AGG-31, AGG-32 (grow-diag-final-and).

The model is t(target | source) on the pairs of words that meet in some sentence pair.  Expected counts are made on arrays of
many sentences at once and added up in the task by (source, target) before anything is shuffled; no table of links is
written.  A round is one aggregation of counts, one of their sums by source word, and a written model.

The E-step of a target word needs t only for that word, so the model goes to the tasks in ranges of target words, each of at
most ``range_pairs`` word pairs and one word more: bounded broadcasts, one pass over the sentences a range.  The model is
written in the order of target words, so that a range reads its own part of the files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcorpus.plans.broadcast import maybe_broadcast, stored
from seqcorpus.plans.session import cut_lineage, shuffle_partitions

#: Word pairs of a broadcast range: 16 bytes each, and 8 more for the counts of a task.
RANGE_PAIRS = 2_000_000
#: The empty word that a target word may come from.
NULL_WORD = -1
#: Cells (a target word with a source word of its sentence) that a task holds at once, in the first round and later, and word pairs that
#: it adds up in the first round.  Sums of doubles, and so equally likely words, follow the blocks.
_FIRST_CELLS = 1 << 23
_CELLS = 1 << 20
_HELD = 1 << 22
#: A range is looked up in a table of all its words if that has at most so many places for each word pair.
_SPARSE = 8


def _pairs(pairs: DataFrame, src: str, tgt: str, keys: list[str]) -> DataFrame:
    whole = lambda c: F.coalesce(F.col(c).cast("array<int>"), F.expr("CAST(array() AS ARRAY<INT>)"))
    return pairs.select(*keys, F.concat(whole(src), F.array(F.lit(NULL_WORD))).alias("src"), whole(tgt).alias("tgt"))


def _normalised(counts: DataFrame) -> DataFrame:
    """t = count / the sum of its source word, written in the order of target words."""
    total = counts.groupBy("src_id").agg(F.sum("c").alias("total"))
    model = counts.join(maybe_broadcast(total), "src_id").select("src_id", "tgt_id", (F.col("c") / F.col("total")).alias("prob"))
    return stored(model.repartitionByRange(shuffle_partitions(model.sparkSession), "tgt_id").sortWithinPartitions("tgt_id"))


def _ranges(model: DataFrame, range_pairs: int) -> list[tuple[int, int]]:
    """Ranges [low, high] of target ids, from the running number of pairs by target word (one row a word of the vocabulary)."""
    by_word = model.groupBy("tgt_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("tgt_id")) - F.col("n")
    cut = by_word.withColumn("r", F.floor(before / range_pairs)).groupBy("r").agg(F.min("tgt_id").alias("low"), F.max("tgt_id").alias("high"))
    return [(r.low, r.high) for r in cut.orderBy("low").collect()]


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, offset of each row) of an array of lists without nulls."""
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[off[0]:off[-1]].astype(np.int64), off - off[0]


def _blocks(src: pa.Array, tgt: pa.Array, cells: int, low: int | None = None, high: int | None = None):
    """Blocks of (row, place, id, number of source words) of target words within [low, high], and the source id of each cell:
    every target word against all source words of its row.  A block ends with the row that exceeds ``cells``, or inside a very long one."""
    (s, s_off), (t, t_off) = _flat(src), _flat(tgt)
    mine = np.arange(len(t)) if low is None else np.flatnonzero((t >= low) & (t <= high))
    row = np.searchsorted(t_off, mine, "right") - 1
    sizes = np.diff(s_off)[row]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(mine):
        base = ends[at] - sizes[at]
        cut = int(np.searchsorted(row, row[min(np.searchsorted(ends, base + cells, "right"), len(mine) - 1)], "right"))
        if ends[cut - 1] - base > 2 * cells:
            cut = max(int(np.searchsorted(ends, base + cells, "right")), at + 1)
        some = slice(at, cut)
        r, n = row[some], sizes[some]
        cell = np.arange(n.sum()) + np.repeat(s_off[r] - (np.cumsum(n) - n), n)
        yield r, mine[some] - t_off[r], t[mine[some]], n, s[cell]
        at = cut


class _Range:
    """The model's pairs of a range of target words, sorted by (target, source)."""

    def __init__(self, model: DataFrame, low: int, high: int):
        rows = model.where(F.col("tgt_id").between(low, high)).select(
            F.expr("shiftleft(CAST(tgt_id AS BIGINT), 32) + src_id + 1").alias("key"), "prob").toArrow()
        key, prob = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(key)
        # behind the pairs: the probability of a pair that the model doesn't have
        self.key, self.prob, self.low, self.high = key[order], np.append(prob[order], -1.0), low, high
        self.width = int((self.key & 0xFFFFFFFF).max(initial=0)) + 2
        places = (high - low + 1) * self.width
        self.table = None
        if places <= _SPARSE * len(self.key):
            self.table = np.full(places, len(self.key), np.int32)
            self.table[((self.key >> 32) - low) * self.width + (self.key & 0xFFFFFFFF)] = np.arange(len(self.key))

    def cells(self, src: pa.Array, tgt: pa.Array):
        """Blocks of (rows, target places, source counts, index of each cell) of target words of the range."""
        for rows, places, t, sizes, s in _blocks(src, tgt, _CELLS, self.low, self.high):
            if self.table is not None:
                at = self.table[np.repeat((t - self.low) * self.width, sizes) + np.minimum(s + 1, self.width - 1)]
            else:
                key = np.repeat(t << 32, sizes) + s + 1
                at = np.searchsorted(self.key, key)
                at[self.key[np.minimum(at, len(self.key) - 1)] != key] = len(self.key)
            yield rows, places, sizes, at


def lexical_em(pairs: DataFrame, src: str, tgt: str, rounds: int = 5, range_pairs: int = RANGE_PAIRS) -> tuple[DataFrame, list[float]]:
    """AGG-31: ``(src_id, tgt_id, prob)`` after ``rounds`` rounds from a uniform start, source id -1 for the empty word, and the
    log-likelihood of the target words under the model that each round but the first started from.

    ``src`` and ``tgt`` are arrays of ids (0 or more).  A null or empty target gives nothing; a null or empty source leaves the empty word."""
    sentences = cut_lineage(_pairs(pairs, src, tgt, []))
    model = _normalised(cut_lineage(_uniform(sentences).groupBy("src_id", "tgt_id").agg(F.sum("c").alias("c"))))
    likelihood = []
    for _ in range(rounds - 1):
        parts = None
        for low, high in _ranges(model, range_pairs):
            part = cut_lineage(_expected(sentences, _Range(model, low, high)).groupBy("src_id", "tgt_id").agg(F.sum("c").alias("c")))
            parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            break
        likelihood.append(parts.where("src_id IS NULL").agg(F.sum("c")).first()[0] or 0.0)
        model = _normalised(parts.where("src_id IS NOT NULL"))  # a pair is in one range
    return model, likelihood


def _counts(key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(((key & 0xFFFFFFFF) - 1).astype(np.int32)), pa.array((key >> 32).astype(np.int32)), pa.array(count)],
                                      names=["src_id", "tgt_id", "c"])


def _uniform(sentences: DataFrame) -> DataFrame:
    """Counts of the first round, in which all source words of a row are equally likely, added up by task."""
    def task(batches):
        add = lambda tables: pa.concat_tables(tables).group_by("key", use_threads=False).aggregate([("c", "sum")]).rename_columns(["key", "c"])
        out = lambda tab: _counts(tab.column("key").to_numpy(), tab.column("c").to_numpy())
        held, n = [], 0
        for batch in batches:
            for _, _, t, sizes, s in _blocks(batch.column(0), batch.column(1), _FIRST_CELLS):
                cells = pa.table({"key": np.repeat(t << 32, sizes) + s + 1, "c": np.repeat(1.0 / sizes, sizes)})
                held.append(add([cells]))
                n += len(held[-1])
                if n > _HELD:
                    held = [add(held)]
                    n = len(held[0])
                    if n > _HELD // 2:
                        yield out(held[0])
                        held, n = [], 0
        if held:
            yield out(add(held))

    return sentences.mapInArrow(task, "src_id int, tgt_id int, c double")


def _expected(sentences: DataFrame, some: _Range) -> DataFrame:
    """Expected counts of a range, added up by task; the task's log-likelihood has no ids."""
    shared = sentences.sparkSession.sparkContext.broadcast(some)

    def task(batches):
        some = shared.value
        count, ll = np.zeros(len(some.prob)), 0.0
        for batch in batches:
            for _, _, sizes, at in some.cells(batch.column(0), batch.column(1)):
                prob, head = some.prob[at], np.cumsum(sizes) - sizes
                z = np.add.reduceat(prob, head)
                count += np.bincount(at, prob / np.repeat(z, sizes), minlength=len(count))
                ll += float(np.log(z / sizes).sum())
        got = np.flatnonzero(count)
        yield _counts(some.key[got], count[got])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([ll])], names=["src_id", "tgt_id", "c"])

    return sentences.mapInArrow(task, "src_id int, tgt_id int, c double")


def best_links(pairs: DataFrame, key_cols: list[str], src: str, tgt: str, model: DataFrame, range_pairs: int = RANGE_PAIRS) -> DataFrame:
    """``(keys, links)``: each target word linked to its likeliest source word (ties: the first), unlinked where that is the
    empty word; sorted by (src_pos, tgt_pos).  Words that the model doesn't have stay unlinked."""
    sentences = cut_lineage(_pairs(pairs, src, tgt, key_cols))
    found = None
    for low, high in _ranges(model, range_pairs):
        part = _linked(sentences, key_cols, _Range(model, low, high))
        found = part if found is None else found.unionByName(part)
    nothing = F.expr("CAST(array() AS ARRAY<STRUCT<src_pos: INT, tgt_pos: INT>>)")
    if found is None:
        return sentences.select(*key_cols, nothing.alias("links"))
    # a row of every range for every sentence; ranges are few
    return found.groupBy(*key_cols).agg(F.array_sort(F.flatten(F.collect_list("links"))).alias("links"))


def _linked(sentences: DataFrame, key_cols: list[str], some: _Range) -> DataFrame:
    shared = sentences.sparkSession.sparkContext.broadcast(some)
    n = len(key_cols)

    def task(batches):
        some = shared.value
        for batch in batches:
            links = [[] for _ in range(batch.num_rows)]
            for rows, places, sizes, at in some.cells(batch.column(n), batch.column(n + 1)):
                prob, head = some.prob[at], np.cumsum(sizes) - sizes
                # the empty word is the last of the row; a word of equal probability goes before it, the first of several
                best = np.flatnonzero(prob == np.repeat(np.maximum.reduceat(prob, head), sizes))
                first = best[np.searchsorted(best, head)]
                linked = (prob[first] > 0) & (first - head < sizes - 1)
                for r, i, j in zip(rows[linked].tolist(), (first - head)[linked].tolist(), places[linked].tolist(), strict=True):
                    links[r].append({"src_pos": i, "tgt_pos": j})
            kind = pa.list_(pa.struct([("src_pos", pa.int32()), ("tgt_pos", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(n)], pa.array(links, kind)], names=[*key_cols, "links"])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema.fields[:n])
    return sentences.mapInArrow(task, f"{keys}, links array<struct<src_pos: int, tgt_pos: int>>")


#: Neighbours in the order in which a point is grown (fixed values of the published heuristic).
NEIGHBOURS = [(-1, 0), (0, -1), (1, 0), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)]


#: A point is one number, its source place times this plus its target place.
_SIDE = 1 << 20


def _grower():
    """The heuristic on two arrays of sorted points, as a function that is sent to the tasks by value."""
    side, neighbours = _SIDE, NEIGHBOURS

    def grow(a: list[int], b: list[int]) -> list[int]:
        union = sorted({*a, *b})
        inside, links = set(union), set(a) & set(b)
        rows, cols = {x // side for x in links}, {x % side for x in links}

        def add(x: int) -> None:
            links.add(x)
            rows.add(x // side)
            cols.add(x % side)

        had = -1
        while len(links) > had:
            had = len(links)
            for p in union:
                if p in links:
                    for ds, dt in neighbours:
                        x = p + ds * side + dt
                        if p % side + dt >= 0 and x in inside and x not in links and (x // side not in rows or x % side not in cols):
                            add(x)
        for x in (*a, *b):
            if x // side not in rows and x % side not in cols:
                add(x)
        return sorted(links)

    def rows_of(a: pa.Array, b: pa.Array) -> pa.Array:
        pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
        return pa.array([None if x is None or y is None else grow(x, y) for x, y in pairs], pa.list_(pa.int64()))

    return rows_of


def grow_diag_final_and(forward: str | Column, backward: str | Column) -> Column:
    """AGG-32, default heuristic, on two arrays of ``struct<src_pos, tgt_pos>`` of the same sentence pair.

    Starts from the intersection.  Grow: points in (source, target) order; each neighbour of a point that is in the union, and
    whose source or target word is free, is added at once and is itself grown, if it comes later in the order, in the same
    sweep; sweeps repeat until one adds nothing.  Final: points of ``forward``, then of ``backward``, both of whose words are free.
    Row-local: a sweep walks the union's points only, since no other point can be in the alignment."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (forward, backward))
    code = lambda col: F.array_sort(F.array_distinct(F.transform(col, lambda x: x["src_pos"].cast("long") * F.lit(_SIDE) + x["tgt_pos"])))
    grown = F.arrow_udf(_grower(), "array<bigint>")(code(a), code(b))
    return F.transform(grown, lambda x: F.struct(F.floor(x / F.lit(_SIDE)).cast("int").alias("src_pos"), (x % F.lit(_SIDE)).cast("int").alias("tgt_pos")))

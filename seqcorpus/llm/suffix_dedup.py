"""Removal of long repeated byte strings by suffix sorting of the contested parts (operator 5).

A window is ``length`` bytes of one document; a byte goes if a window that covers it starts anywhere else
too.  Only a small part of the text has to be sorted:

1. Runs.  Each window has an anchor: the smallest (leftmost if equal) hash of its ``GRAM``-byte substrings,
   so equal windows have equal anchors at equal offsets.  Neighbouring windows of one anchor are a run.
2. Equal runs.  Runs with equal anchor and content are counted by an aggregation (exact copies of documents
   and passages end here); anchors seen once are done.
3. Contested runs.  Where an anchor has runs of different content, one of each content is dealt, by anchor,
   to shards of about ``SHARD_BYTES``.  Each task sorts the suffixes of its shard by induced sorting with
   disk-backed queues (:mod:`induced_sort`) and compares neighbours' common prefixes with ``length``.
   An anchor of more than ``RUNS`` contents is dealt over several shards; its windows that are alone in their
   shard then meet by two 64-bit fingerprints, in an aggregation.
4. The spans of each document are merged and cut out of its bytes.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than ``length`` lose none;
repeated rows (same doc_id and text) count as documents of their own, so they lose all from ``length`` bytes
on; an empty table gives an empty result; extra columns pass through :func:`remove_repeats`, whose own names
start with ``_s``.  Texts are read whole, in overlapping steps of ``STEP`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from seqcorpus.llm.common import slices, text_buffers, written
from seqcorpus.llm.induced_sort import suffix_array
from seqcorpus.llm.words import BASE, BYTE_VALUE, STEP as SECOND, mix

GRAM = 100
STEP = 1 << 20
SHARD_BYTES = 1 << 20
RUNS = 8192
_PLACE = np.uint64((1 << 24) - 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class PrefixHash:
    """Hashes of any substring of a byte array."""

    def __init__(self, a: np.ndarray, values: np.ndarray = BYTE_VALUE):
        power = np.cumprod(np.append(np.uint64(1), np.full(len(a), BASE)), dtype=np.uint64)
        self.prefix = np.append(np.uint64(0), np.cumsum(values[a] * power[:-1], dtype=np.uint64))
        self.shift = np.cumprod(np.append(np.uint64(1), np.full(len(a), _INVERSE)), dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.shift[start])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by minima from block borders forth and back."""
    pad = -len(x) % width
    blocks = np.append(x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    forth = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(x) - width + 1], forth[width - 1:len(x)])


def runs_of(a: np.ndarray, bounds: np.ndarray, length: int, gram: int):
    """Runs in bytes ``a`` of rows with offsets ``bounds``: (row, start in the row, windows, anchor, content, times).
    A run that is followed by its like again and again (periodic text) is one of so many ``times``."""
    none = np.zeros(0, np.int64)
    if len(a) < length:
        return none, none, none, none, none, none
    h = PrefixHash(a)
    at = np.arange(len(a) - gram + 1)
    g = h.of(at, at + gram)
    least = sliding_least(g & ~_PLACE | at.astype(np.uint64), length - gram + 1)
    size = np.diff(bounds)
    rows = np.flatnonzero(size >= length)
    windows = size[rows] - length + 1
    starts = np.arange(windows.sum()) + np.repeat(bounds[rows] - (np.cumsum(windows) - windows), windows)
    if not len(starts):
        return none, none, none, none, none, none
    anchor_at = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor_at[1:] != anchor_at[:-1]) | (starts[1:] != starts[:-1] + 1)))
    n = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    content = mix(h.of(begin, begin + n - 1 + length) + n.astype(np.uint64))
    row = np.searchsorted(bounds, begin, "right") - 1
    anchor = g[anchor_at[first]]
    like = (row[1:] == row[:-1]) & (n[1:] == n[:-1]) & (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
    head = np.flatnonzero(np.append(True, ~like))
    times = np.diff(np.append(head, len(begin)))
    return row[head], (begin - bounds[row])[head], n[head], anchor[head].view(np.int64), content[head].view(np.int64), times


def runs(docs: DataFrame, length: int, gram: int, text: str) -> DataFrame:
    """(_sdoc, anchor, content, start, n, times): the runs of every document; _sdoc names the row."""
    def task(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            data, off = text_buffers(batch.column(1))
            for lo, hi in slices(off, STEP):
                last = off[hi]
                for c in range(int(off[lo]), max(int(last) - length + 1, int(off[lo]) + 1), STEP * 4):  # one step but for a long text
                    end = min(int(last), c + STEP * 4 + length - 1)
                    bounds = np.clip(off[lo:hi + 1], c, end) - c
                    row, start, n, anchor, content, times = runs_of(data[c:end], bounds, length, gram)
                    start = start + np.maximum(c - off[lo:hi], 0)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi][row]), pa.array(anchor), pa.array(content), pa.array(start), pa.array(n), pa.array(times)],
                                                     names=["_sdoc", "anchor", "content", "start", "n", "times"])

    return docs.select("_sdoc", text).mapInArrow(task, "_sdoc long, anchor long, content long, start long, n long, times long")


def sort_shard(bodies: list[bytes], n: np.ndarray, length: int):
    """Sort the suffixes of a shard.  Per window, in run order: its group of equal windows (a number), and
    two fingerprints."""
    size = np.array([len(b) + 1 for b in bodies])
    begin = np.cumsum(size) - size
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    t = raw.astype(np.int32) + 2
    t[begin + size - 1] = 1
    order = suffix_array(np.append(t, 0), depth=length)
    at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    is_window = np.zeros(len(t) + 1, bool)
    is_window[at] = True
    order = order[is_window[order]]
    one = PrefixHash(raw).of(at, at + length)
    two = PrefixHash(raw, BYTE_VALUE * SECOND ^ (BYTE_VALUE >> np.uint64(31))).of(at, at + length)
    place = np.empty(len(t) + 1, np.int64)
    place[at] = np.arange(len(at))
    w = place[order]
    # windows of one sorted neighbourhood whose common prefix reaches ``length``
    new = np.append(True, (one[w][1:] != one[w][:-1]) | (two[w][1:] != two[w][:-1]))
    group = np.empty(len(at), np.int64)
    group[w] = np.cumsum(new) - 1
    return group, one.view(np.int64), two.view(np.int64)


_SORTED = "anchor long, content long, first long, n long, one long, two long, found boolean"


def _shard_task(length: int):
    def task(tab: pa.Table) -> pa.Table:
        anchor, content = tab.column("anchor").to_numpy(), tab.column("content").to_numpy()
        n, copies, hot = (tab.column(c).to_numpy(zero_copy_only=False) for c in ("n", "copies", "hot"))
        group, one, two = sort_shard(tab.column("body").to_pylist(), n, length)
        run = np.repeat(np.arange(len(n)), n)
        rel = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        found = np.bincount(group)[group] > 1
        mine = found & (copies[run] == 1)  # runs seen twice are removed as wholes
        at = np.flatnonzero(mine)
        cut = np.append(True, (run[at][1:] != run[at][:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool)
        head = at[cut]
        count = np.diff(np.append(np.flatnonzero(cut), len(at)))
        # hot anchors: what is alone here may have its like in another shard; of what is not, one tells
        known = found | (copies[run] > 1)
        single = np.flatnonzero(hot[run] & ~known)
        told = np.flatnonzero(hot[run] & known)
        told = told[np.unique(group[told], return_index=True)[1]]
        more = np.concatenate([single, told])
        none = pa.nulls(len(head), pa.int64())
        return pa.table({
            "anchor": np.concatenate([anchor[run[head]], anchor[run[more]]]), "content": np.concatenate([content[run[head]], content[run[more]]]),
            "first": np.concatenate([rel[head], rel[more]]), "n": np.concatenate([count, np.ones(len(more), np.int64)]),
            "one": pa.concat_arrays([none, pa.array(one[more])]), "two": pa.concat_arrays([none, pa.array(two[more])]),
            "found": np.concatenate([np.ones(len(head), bool), np.zeros(len(single), bool), np.ones(len(told), bool)])})

    return task


def repeated_spans(keyed: DataFrame, length: int, gram: int, text: str) -> DataFrame:
    """(_sdoc, start, n): starts and numbers of windows that occur elsewhere too."""
    every = written(runs(keyed, length, gram, text), "runs")
    often = every.groupBy("anchor").agg(F.sum("times").alias("c")).where("c > 1").select("anchor")
    often = written(often, "frequent-anchors")  # a join of two tables, whose hot anchors Spark can split
    shared = written(every.join(often, "anchor"), "shared-runs")
    contents = shared.groupBy("anchor", "content").agg(F.sum("times").alias("copies"), F.min(F.struct("_sdoc", "start", "n")).alias("r"))
    contents = written(contents.select("anchor", "content", "copies", "r.*"), "run-contents")
    whole = shared.join(contents.where("copies > 1").select("anchor", "content"), ["anchor", "content"]).select("_sdoc", "start", (F.col("n") * F.col("times")).alias("n"))
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    contested = contents.join(several, "anchor")
    contested = written(contested.withColumn("salt", F.pmod(F.xxhash64("content"), F.ceil(F.col("d") / RUNS))).withColumn("hot", F.col("d") > RUNS), "contested")
    total = contested.agg(F.sum(F.col("n") + length)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    wanted = contested.groupBy("_sdoc").agg(F.collect_list(F.struct("anchor", "content", "copies", "start", "n", "salt", "hot")).alias("r"))
    bodies = keyed.select("_sdoc", F.col(text).cast("binary").alias("b")).join(wanted, "_sdoc").select("b", F.explode("r").alias("r"))
    bodies = bodies.select("r.anchor", "r.content", "r.copies", "r.n", "r.hot", F.expr(f"substring(b, cast(r.start + 1 as int), cast(r.n + {length - 1} as int))").alias("body"),
                           F.pmod(F.xxhash64("r.anchor", "r.salt"), F.lit(shards)).alias("shard"))
    done = written(bodies.groupBy("shard").applyInArrow(_shard_task(length), _SORTED), "sorted-shards")
    alone = done.where("one IS NOT NULL")
    met = alone.groupBy("one", "two").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("one", "two")
    met = alone.where("NOT found").join(met, ["one", "two"])
    parts = done.where("one IS NULL").select("anchor", "content", "first", "n").unionAll(met.select("anchor", "content", "first", "n"))
    parts = parts.join(contested.select("anchor", "content", "_sdoc", "start"), ["anchor", "content"])
    return whole.unionAll(parts.select("_sdoc", (F.col("start") + F.col("first")).alias("start"), "n"))


def cut_spans(raw: bytes, starts: list[int], counts: list[int], length: int) -> tuple[bytes, int, int]:
    """The bytes left, the number removed and the number of maximal removed spans."""
    if not starts:
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + np.asarray(counts) - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text",
                   as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (binary, or with ``as_text`` a string without the parts of cut characters),
    ``n_bytes``, ``n_removed`` and ``n_spans``."""
    key = F.xxhash64(F.col(doc_id), F.col(text))
    spans = repeated_spans(docs.select(key.alias("_sdoc"), text), length, gram, text)
    spans = spans.distinct().groupBy("_sdoc").agg(F.collect_list("start").alias("_sstart"), F.collect_list("n").alias("_sn"))
    joined = docs.withColumn("_sdoc", key).join(spans, "_sdoc", "left")

    def task(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
            starts, counts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_sstart", "_sn"))
            rows = [cut_spans(t or b"", s or [], n or [], length) for t, s, n in zip(texts, starts, counts, strict=True)]
            names = [c for c in batch.schema.names if not c.startswith("_s") and c not in new]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array([r[0].decode("utf-8", "ignore") for r in rows], pa.string()) if as_text else pa.array([r[0] for r in rows], pa.binary()), pa.array([len(t or b"") for t in texts], pa.int64()),
                   pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=[*names, *new])

    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    made = [StructField("kept", StringType() if as_text else BinaryType()), *[StructField(c, LongType()) for c in new[1:]]]
    return joined.mapInArrow(task, StructType([f for f in docs.schema if f.name not in new and not f.name.startswith("_s")] + made))

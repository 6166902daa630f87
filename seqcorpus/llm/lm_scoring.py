"""Language-model scores from a log-frequency Bloom filter (operator 4).

Documents are cut into units of about ``slice_words`` words.  A task hashes a unit's distinct words and word
pairs to 64 bits, counts them in its training documents, and deals them by hash to segments, as packed
arrays; n-grams of held-out documents go along with a count of 0.  The task of a segment adds up the counts,
quantises those of pairs to levels (1 + floor(log_base count)) and sets, for every level from 1 to that,
``HASHES`` bits of its segment of the filter, which has ``BITS`` bits for each insertion whatever the corpus.
It answers each unit with the exact counts of its words and the levels of its pairs, read from the filter by
probing levels until one is absent.  Units and answers meet again by unit, in the order of the hashes, so
answers need no keys.  Neither the filter nor the vocabulary is gathered anywhere: a task holds one unit, or
one segment, and there are as many segments as units / ``UNITS`` (64 at least).

Scores interpolate p(word | previous) = c(pair) / c(previous), from count levels, with the smoothed unigram
(c + 1) / (N + V + 1); the weight depends on the level of c(previous) and maximises the leave-one-out
likelihood on all training documents.

Defined cases: null, empty and wordless texts are one end token; a null doc_id counts as the empty text for
the training split; repeated rows count and score each; no training documents give N = V = 0, score and
base 0 for every token; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcorpus.llm.common import slices, text_buffers, written
from seqcorpus.llm.words import BASE, STEP, mix, words_of

END = np.uint64(0x5EED0E0D)
START = np.uint64(0x5EED57A7)
LEVEL_BASE = 1.5
BITS, HASHES = 8, 4
#: Text bytes that stand for a word, and documents that a unit holds at most.
WORD_BYTES, UNIT_ROWS = 6, 1 << 16
#: Units whose n-grams share one merge task.
UNITS = 8
WEIGHTS = np.array([0.0, 0.02, 0.05, *np.arange(0.1, 1.0, 0.05), 0.98])
LEVELS = 64


def tokens(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token and of the one before it, and the number of tokens of each row."""
    w = words_of(data, off, lo, hi)
    n = np.diff(w.first) + 1
    ends = np.cumsum(n)
    tok = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    is_end = np.zeros(len(tok), bool)
    is_end[ends - 1] = True
    tok[is_end] = END
    tok[~is_end] = w.hash
    before = np.append(START, tok[:-1])
    before[ends - n] = START
    return tok, before, n


def pair_key(before: np.ndarray, tok: np.ndarray) -> np.ndarray:
    return mix(before * STEP + tok * BASE)


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(count) / np.log(LEVEL_BASE) + 1e-9), LEVELS - 1).astype(np.int64)


def level_counts() -> np.ndarray:
    """The mean whole number of each level's range (0 for level 0)."""
    out = np.zeros(LEVELS)
    for q in range(1, LEVELS):
        low, high = np.ceil(LEVEL_BASE ** (q - 1) - 1e-9), np.ceil(LEVEL_BASE**q - 1e-9) - 1
        out[q] = max((low + max(low, high)) / 2, out[q - 1])
    return out


def _probes(key: np.ndarray, level: int, size: np.ndarray):
    h = mix(key + np.uint64(level * int(BASE) & 0xFFFFFFFFFFFFFFFF))
    step = (h >> np.uint64(33)) * np.uint64(2) + np.uint64(1)
    for _ in range(HASHES):
        yield (h % size).astype(np.int64)
        h = h + step


def filter_segment(key: np.ndarray, count: np.ndarray, most: int | None = None) -> np.ndarray:
    """Packed bits of one segment: ``BITS`` for each insertion, at most ``most`` (the operator sets no bound)."""
    level = level_of(count)
    size = BITS * int(level.sum())
    size = max(64, size if most is None else min(size, most))
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _probes(key[level >= q], q, np.uint64(size)):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


class LogFrequencyFilter:
    """The whole filter: ``bits`` holds the segments' bits one after another, ``size`` their numbers."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        self.bits, self.size = bits, size
        self.start = np.cumsum(size).astype(np.int64) - size.astype(np.int64)

    def level(self, key: np.ndarray) -> np.ndarray:
        """The count level of each key: levels are probed until one is absent."""
        out = np.zeros(len(key), np.int64)
        if not len(self.size):
            return out
        seg = segment_of(key, len(self.size))
        size, start = self.size[seg], self.start[seg]
        live = np.arange(len(key))
        for q in range(1, LEVELS):
            ok = np.ones(len(live), bool)
            for at in _probes(key[live], q, size[live]):
                at += start[live]
                ok &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
            live = live[ok]
            if not len(live):
                break
            out[live] = q
        return out


def squeezed(values: np.ndarray) -> bytes:
    """Values by byte planes, compressed, after the number of bytes: high bytes of sorted hashes and of counts repeat."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unsqueezed(blob: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def units_of(rows: DataFrame, unit_bytes: int) -> DataFrame:
    """(unit, ids, held, sizes, raw, blob): documents (doc_id, held_out, text) in units of about ``unit_bytes``
    text bytes, the texts joined and compressed."""
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("unit", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.BinaryType()),
                           T.StructField("sizes", T.BinaryType()), T.StructField("raw", T.LongType()), T.StructField("blob", T.BinaryType())])

    def task(batches):
        part, made, bytes_, ids, held, sizes, texts = 0, 0, 0, [], [], [], []

        def unit():
            raw = b"".join(texts)
            ids_ = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids_)], pa.int32()), ids_),
                pa.array([np.concatenate(held).tobytes()], pa.binary()), pa.array([np.concatenate(sizes).astype(np.int64).tobytes()], pa.binary()),
                pa.array([len(raw)], pa.int64()), pa.array([pa.compress(raw, codec="zstd", asbytes=True)], pa.binary())], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(3)[0].as_py()
            data, off = text_buffers(batch.column(2))
            out = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for lo, hi in slices(off, min(unit_bytes, 1 << 20)):
                ids.append(batch.column(0).slice(lo, hi - lo))
                held.append(out[lo:hi])
                sizes.append(np.diff(off[lo:hi + 1]))
                texts.append(data[off[lo]:off[hi]].tobytes())
                bytes_ += len(texts[-1])
                if bytes_ >= unit_bytes or sum(map(len, held)) >= UNIT_ROWS:
                    yield unit()
                    made, bytes_ = made + 1, 0
                    for x in (ids, held, sizes, texts):
                        x.clear()
        if ids:
            yield unit()

    return rows.select("doc_id", "held_out", "text", F.spark_partition_id().alias("part")).mapInArrow(task, schema)


class Unit:
    """A unit's tokens, and its distinct words and pairs in the order of their segments."""

    def __init__(self, blob: bytes, raw: int, sizes: bytes, held: bytes, segments: int):
        data = np.frombuffer(pa.decompress(blob, decompressed_size=raw, codec="zstd", asbytes=True), np.uint8) if raw else np.zeros(0, np.uint8)
        off = np.append(0, np.cumsum(np.frombuffer(sizes, np.int64)))
        parts = [tokens(data, off, lo, hi) for lo, hi in slices(off)]
        tok, before = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        self.n = np.concatenate([p[2] for p in parts])
        self.train = np.repeat(np.frombuffer(held, np.uint8) == 0, self.n)
        # places of each token, of the one before it, and of its pair; a document starts after an end
        self.words, self.tok = self._distinct(tok, segments)
        self.before = np.append(0, self.tok[:-1])
        self.before[np.cumsum(self.n) - self.n] = self.tok[np.cumsum(self.n) - 1]
        self.pairs, self.pair = self._distinct(pair_key(before, tok), segments)

    @staticmethod
    def _distinct(key, segments):
        key, at = np.unique(key, return_inverse=True)
        order = np.argsort(segment_of(key, segments), kind="stable")
        place = np.empty(len(key), np.int64)
        place[order] = np.arange(len(key))
        return key[order], place[at]

    def times(self, at: np.ndarray, size: int) -> np.ndarray:
        """How often training documents have each word or pair."""
        return np.bincount(at[self.train], minlength=size)


def _unit_rows(tab, segments: int):
    for r in range(tab.num_rows):
        blob, raw, sizes, held = (tab.column(tab.schema.get_field_index(c))[r].as_py() for c in ("blob", "raw", "sizes", "held"))
        yield r, Unit(blob, raw, sizes, held, segments)


def count_ngrams(units: DataFrame, segments: int) -> DataFrame:
    """(segment, unit, words, word_counts, pairs, pair_counts): what each unit asks each segment."""
    names = ["segment", "unit", "words", "word_counts", "pairs", "pair_counts"]

    def task(batches):
        for batch in batches:
            for r, u in _unit_rows(batch, segments):
                cols, cuts = [], []
                for key, at in ((u.words, u.tok), (u.pairs, u.pair)):
                    cut = np.searchsorted(segment_of(key, segments), np.arange(segments + 1)).tolist()
                    count = u.times(at, len(key)).astype(np.uint32)
                    cuts.append(cut)
                    cols += [[squeezed(x[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (key, count)]
                some = [s for s in range(segments) if any(c[s + 1] > c[s] for c in cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([batch.column(0)[r].as_py()] * len(some), pa.int64()),
                                                  *(pa.array([c[s] for s in some], pa.binary()) for c in cols)], names=names)

    return units.select("unit", "held", "sizes", "raw", "blob").mapInArrow(task, "segment int, unit long, words binary, word_counts binary, pairs binary, pair_counts binary")


def answers(counted: DataFrame) -> DataFrame:
    """(segment, unit, counts, levels, n, v): each unit's word counts and pair levels, in the order it asked;
    a row of no unit has the segment's numbers of training tokens and of different training words."""
    def merged(tab, keys, counts):
        parts = [unsqueezed(x, np.uint64) for x in tab.column(keys).to_pylist()]
        key, at = np.unique(np.concatenate(parts), return_inverse=True)
        given = np.concatenate([unsqueezed(x, np.uint32) for x in tab.column(counts).to_pylist()])
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, given)
        return key, total, at, np.cumsum([len(x) for x in parts])[:-1]

    def task(tab: pa.Table) -> pa.Table:
        _, total, at, cut = merged(tab, "words", "word_counts")
        key, times, pair_at, pair_cut = merged(tab, "pairs", "pair_counts")
        seen = times > 0
        bits = filter_segment(key[seen], times[seen])
        level = LogFrequencyFilter(bits, np.array([8 * len(bits)], np.uint64)).level(key).astype(np.uint8)
        rows = tab.num_rows
        return pa.table({
            "segment": pa.array([tab.column("segment")[0].as_py()] * (rows + 1), pa.int32()), "unit": pa.array([*tab.column("unit").to_pylist(), None], pa.int64()),
            "counts": pa.array([*(squeezed(x) for x in np.split(total[at], cut)), None], pa.binary()),
            "levels": pa.array([*(squeezed(x) for x in np.split(level[pair_at], pair_cut)), None], pa.binary()),
            "n": pa.array([None] * rows + [int(total.sum())], pa.int64()), "v": pa.array([None] * rows + [int((total > 0).sum())], pa.int64())})

    return counted.groupBy("segment").applyInArrow(task, "segment int, unit long, counts binary, levels binary, n long, v long")


def _answered(left: pa.Table, right: pa.Table, segments: int):
    """A unit with the count of each word and the level of each pair."""
    order = np.argsort(right.column("segment").to_numpy())
    counts, levels = (right.column(c).to_pylist() for c in ("counts", "levels"))
    (_, u), = _unit_rows(left.combine_chunks(), segments)
    count = np.concatenate([unsqueezed(counts[i], np.int64) for i in order])
    level = np.concatenate([unsqueezed(levels[i], np.uint8) for i in order]).astype(np.int64)
    if len(count) != len(u.words) or len(level) != len(u.pairs):
        raise ValueError(f"{len(count)} counts and {len(level)} levels for {len(u.words)} words and {len(u.pairs)} pairs of a unit")
    return u, count, level


def parts(u: Unit, count: np.ndarray, level: np.ndarray, n: int, v: int, less: int = 0):
    """Training count and unigram probability of the last word, pair probability, and level of the previous
    word, of each distinct pair."""
    first = np.zeros(len(u.pairs), np.int64)
    first[u.pair] = np.arange(len(u.pair))
    c, before = count[u.tok[first]], count[u.before[first]]
    uni = (np.maximum(c - less, 0) + 1) / (n + v + 1)
    value, prev = level_counts(), np.where(before > 0, level_of(np.maximum(before, 1)), 0)
    pair = np.maximum(value[level] - less, 0) / np.maximum(value[np.maximum(prev, level)] - less, 1)
    return c, uni, np.minimum(pair, 1.0), prev


def tune(units: DataFrame, replies: DataFrame, segments: int, n: int, v: int) -> np.ndarray:
    """The weight of each level of the previous word: a table of log likelihoods, summed over all units."""
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        u, count, level = _answered(left, right, segments)
        times = u.times(u.pair, len(u.pairs))
        _, uni, pair, prev = (x[times > 0] for x in parts(u, count, level, n, v, less=1))
        times = times[times > 0]
        total = np.stack([np.bincount(prev, times * np.log10(w * pair + (1 - w) * uni), minlength=LEVELS) for w in WEIGHTS], axis=1)
        some = np.flatnonzero(total)
        return pa.table({"at": pa.array(some, pa.int64()), "x": pa.array(total.ravel()[some], pa.float64())})

    left = units.select("unit", "held", "sizes", "raw", "blob")
    found = left.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(task, "at long, x double")
    got = {r.at: r.x for r in found.groupBy("at").agg(F.sum("x").alias("x")).collect()}
    table = np.array([got.get(k, 0.0) for k in range(LEVELS * len(WEIGHTS))]).reshape(LEVELS, -1)
    return WEIGHTS[np.argmax(table, axis=1)]


@contextmanager
def shuffles_removed(spark):
    """Jobs in here remove their shuffle files when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_words: int = 1 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    split = F.pmod(F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")), F.lit(7)) == 2
    rows = docs.select(F.col(doc_id).alias("doc_id"), split.alias("held_out"), F.col(text).alias("text"))
    units = written(units_of(rows, WORD_BYTES * slice_words), "units")
    segments = max(64, units.count() // UNITS)
    with shuffles_removed(docs.sparkSession):
        asked = written(answers(count_ngrams(units, segments)), "answers")
    n, v = (x or 0 for x in asked.where("unit IS NULL").agg(F.sum("n"), F.sum("v")).first())
    replies = asked.where("unit IS NOT NULL").select("unit", "segment", "counts", "levels")
    with shuffles_removed(docs.sparkSession):
        weight = tune(units, replies, segments, n, v) if n else np.zeros(LEVELS)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
                           *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        u, count, level = _answered(left, right, segments)
        c, uni, pair, prev = parts(u, count, level, n, v)
        w = weight[prev]
        row = np.repeat(np.arange(len(u.n)), u.n)
        known, base, both = (np.bincount(row, x[u.pair], minlength=len(u.n)) for x in (c > 0, np.log10(uni), np.log10(w * pair + (1 - w) * uni)))
        held = np.frombuffer(left.column("held")[0].as_py(), np.uint8) > 0
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(held), pa.array(u.n.astype(np.int64)), pa.array(known.astype(np.int64)),
                         pa.array(np.full(len(u.n), n, np.int64)), pa.array(base), pa.array(both)], names=schema.names)

    return units.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(task, schema)

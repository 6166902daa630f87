"""Exact Jaccard join of documents on word shingles by signature trees (operator 2).

Two documents link when 100 * |A n B| >= 80 * |A u B| over their distinct 5-word shingles (both numbers are
parameters).  The steps, each a Spark job over all documents:

1. Sets.  Each text becomes a set of 56-bit shingle hashes; documents of one set (fingerprint and size) are
   one node from here on.  A table of shingle counts by hash bucket, of fixed size, gives an order from rare
   to frequent.
2. Routing.  Two linked sets share one of the first n - ceil(0.8 n) + 1 shingles in that order, so a node
   is dealt to these shingles' lists, and only lists of two nodes or more go on, equal lists once.  In a list
   of up to ``BLOCK`` nodes, one stays only if by its size and the shingle's place in its set it could be
   linked with another one (what a linked pair has in common begins at its first common shingle).
3. Candidates.  In each list a signature tree is built: a leaf holds a node's bitmap of its shingles and
   its size, an inner node the OR of its children's bitmaps and their range of sizes.  A dual traversal of
   the tree with itself drops pairs of tree nodes by their maximum possible overlap, by sizes alone or by
   common bits.  What is left is a candidate graph; a list gives a spanning forest of it, never its
   pairs.  A list of more than ``BLOCK`` nodes is taken as one candidate group unseen.
4. Links.  Only sets of candidate nodes are moved.  A component of the candidate graph is cut into blocks of ``BLOCK`` nodes; each task holds two
   blocks and their sets, and the same traversal ends in exact comparisons, which skip nodes that are
   already connected.  First every block meets the first one; then the nodes outside the largest
   component meet one another and all blocks.  So every pair that could join two components is compared,
   and no task holds more than two blocks.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are their own
components; fewer than five words are one shingle of their whole sequence; repeated rows (doc_id included)
are one document with repeated output rows; a null doc_id gets a null component unless a copy or near copy
has an id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqcorpus.llm.common import text_buffers, written
from seqcorpus.llm.components import components
from seqcorpus.llm.words import mix, shingles, words_of

#: Nodes in a block of an exact comparison; a task holds two blocks.
BLOCK = 256
#: Shingles in a block, for long documents.
BLOCK_SHINGLES = 1 << 19
#: Places in lists that one candidate task gets.
DEAL = 20_000
COUNT_BITS = 18
CHUNK = 4096
#: Rows and bytes of one numpy step (the row number takes 8 bits of a sort key).
STEP_ROWS, STEP_BYTES = 256, 1 << 20
FILTER_BITS = 26
#: Sets of many documents whose dealer is told to all tasks (16 bytes each).
OWNERS = 1 << 18
#: Shingles of a set up to which comparisons take 40 bits of a hash; linked sets differ by a quarter in size at most.
WIDE = 4096
FIRST_40 = np.uint64(((1 << 40) - 1) << 16)
MASK = np.uint64((1 << 56) - 1)
FANOUT = 8
_INT = np.iinfo(np.int32).max


# ---- sets of an Arrow column -------------------------------------------------------------------

def text_sets(arr: pa.Array, width: int = 5):
    """Yield (lo, hi, sorted distinct shingle hashes, offsets by row) over slices of rows."""
    data, off = text_buffers(arr)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + STEP_BYTES, "right")) - 1), lo + STEP_ROWS, n)
        h, row = shingles(words_of(data, off, lo, hi), width)
        key = (row - lo).astype(np.uint64) << np.uint64(56) | (h & MASK)
        key.sort()
        if len(key):
            key = key[np.append(True, key[1:] != key[:-1])]
        bounds = np.searchsorted(key >> np.uint64(56), np.arange(hi - lo + 1))
        yield lo, hi, key & MASK, bounds
        lo = hi


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit value of each row's set (0: empty)."""
    sums = np.append(np.uint64(0), np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64))
    n = np.diff(bounds).astype(np.uint64)
    return np.where(n > 0, mix(sums[bounds[1:]] - sums[bounds[:-1]] + n) | np.uint64(1), np.uint64(0)).view(np.int64)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(56 - COUNT_BITS)).astype(np.int64)


def _blob_rows(values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Non-zero chunks of a table, numbered."""
    parts = values.reshape(-1, CHUNK)
    some = np.flatnonzero(parts.any(axis=1))
    return some.tolist(), [parts[k].tobytes() for k in some]


def _sum_blobs(df: DataFrame, kind: str, combine: str) -> bytes:
    """Combine the tasks' chunks (add or bitwise_or) and bring the table, of fixed size, to the driver."""
    def merge(key, tab):
        acc = None
        for b in tab.column("blob").to_pylist():
            x = np.frombuffer(b, kind)
            acc = x.copy() if acc is None else getattr(np, combine)(acc, x)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([acc.tobytes()], pa.binary())})

    return {r.chunk: r.blob for r in df.groupBy("chunk").applyInArrow(merge, "chunk int, blob binary").collect()}


def _table_of(chunks: dict[int, bytes], size: int, kind: str) -> np.ndarray:
    out = np.zeros(size, kind)
    per = CHUNK
    for k, b in chunks.items():
        out[k * per:(k + 1) * per] = np.frombuffer(b, kind)
    return out


def set_table(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, fp) of every document, and the shingle counts by hash bucket."""
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()),
                           T.StructField("chunk", T.IntegerType()), T.StructField("blob", T.BinaryType())])

    def task(batches):
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        id_type = None
        for batch in batches:
            n, fp = [], []
            for _, _, h, bounds in text_sets(batch.column(1), width):
                n.append(np.diff(bounds))
                fp.append(fingerprints(h, bounds))
                counts += np.bincount(bucket(h), minlength=len(counts))
            rows, id_type = batch.num_rows, batch.schema.field(0).type
            cat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cat(n)), pa.array(cat(fp)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=schema.names)
        if id_type is not None:
            chunks, blobs = _blob_rows(counts)
            none = pa.nulls(len(chunks), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(chunks), id_type), none, none, pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], names=schema.names)

    out = written(docs.select(doc_id, text).mapInArrow(task, schema), "shingle-sets")
    chunks = _sum_blobs(out.where("chunk IS NOT NULL").select("chunk", "blob"), "int64", "add")
    return out.where("chunk IS NULL").select("doc_id", "n", "fp"), _table_of(chunks, 1 << COUNT_BITS, "int64")


class Owners:
    """The document that deals a set which many have, for the ``OWNERS`` sets of the most documents: without them every task that
    reads one of the copies would deal it.  Other sets are dealt by each task that has them, which is only more work."""

    def __init__(self, sets: DataFrame):
        most = sets.where("n > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.min(F.xxhash64("doc_id")).alias("own")).where("c > 1")
        top = most.orderBy(F.desc("c"), "fp").limit(OWNERS).select("fp", "own").toArrow()
        fp, own = (top.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(fp)
        self.fp, self.own = fp[order], own[order]

    def deals(self, fp: np.ndarray, document: np.ndarray) -> np.ndarray:
        """Whether each document (by the hash of its id) deals its set."""
        if not len(self.fp):
            return np.ones(len(fp), bool)
        at = np.minimum(np.searchsorted(self.fp, fp), len(self.fp) - 1)
        return (self.fp[at] != fp) | (self.own[at] == document)


def routes(docs: DataFrame, counts: np.ndarray, width: int, least: int, owners: Owners, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, n, most): the rare shingles that a linked set must share one of, the size of the set, and the size
    up to which another set can be linked whose first common shingle is this one."""
    # 8 bits of the bucket's logarithmic count, then 48 bits of the hash: an order of all shingles
    rank = np.minimum(12 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((rank, owners))

    def task(batches):
        (rank, owners), known = shared.value, set()
        for batch in batches:
            document = batch.column(0).to_numpy()
            for lo, hi, h, bounds in text_sets(batch.column(1), width):
                fp, n = fingerprints(h, bounds), np.diff(bounds)
                new, deals = np.zeros(len(n), bool), owners.deals(fp, document[lo:hi])
                for i, f in enumerate(fp.tolist()):
                    if f and deals[i] and f not in known:  # copies within a task are dealt once
                        known.add(f)
                        new[i] = True
                row = np.repeat(np.arange(len(n)), n)
                key = row.astype(np.uint64) << np.uint64(56) | rank[bucket(h)].astype(np.uint64) << np.uint64(48) | h & np.uint64((1 << 48) - 1)
                key.sort()
                first = n - (least * n + 99) // 100 + 1
                place = np.arange(len(key)) - bounds[:-1][row]
                take = (place < first[row]) & new[row]
                take[1:] &= key[1:] != key[:-1]
                key, row, place = key[take], row[take], place[take]
                most = (100 + least) * (n[row] - place) // least - n[row]
                yield pa.RecordBatch.from_arrays([pa.array((key & MASK).view(np.int64)), pa.array(fp[row]), pa.array(n[row].astype(np.int32)),
                                                  pa.array(np.minimum(most, _INT).astype(np.int32))], names=["key", "fp", "n", "most"])

    return docs.select(F.xxhash64(doc_id), text).mapInArrow(task, "key long, fp long, n int, most int")


def fp_filter(fps: DataFrame) -> np.ndarray:
    """A one-hash filter of fingerprints, of fixed size: it may let others pass, which a join drops."""
    def task(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            at = _filter_at(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        chunks, blobs = _blob_rows(bits)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])

    got = _sum_blobs(fps.mapInArrow(task, "chunk int, blob binary"), "uint8", "bitwise_or")
    return _table_of(got, 1 << (FILTER_BITS - 3), "uint8")


def _filter_at(fp: np.ndarray) -> np.ndarray:
    return (mix(fp.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def node_sets(docs: DataFrame, fps: DataFrame, width: int, owners: Owners, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(fp, part, n, bitmap, items) of the sets whose fingerprints are in ``fps``; a set that several tasks
    saw has a row for each of them, told apart by ``part``."""
    shared = docs.sparkSession.sparkContext.broadcast((fp_filter(fps), owners))

    def task(batches):
        (bits, owners), known = shared.value, set()
        for batch in batches:
            document = batch.column(0).to_numpy()
            for lo, hi, h, bounds in text_sets(batch.column(1), width):
                fp = fingerprints(h, bounds)
                at = _filter_at(fp)
                asked = (bits[at >> 3] >> (at & 7) & 1).astype(bool) & (fp != 0) & owners.deals(fp, document[lo:hi])
                rows = [i for i in np.flatnonzero(asked).tolist() if fp[i] not in known]
                rows = list({fp[i]: i for i in rows}.values())
                known.update(fp[rows].tolist())
                items = [h[bounds[i]:bounds[i + 1]] for i in rows]
                yield pa.RecordBatch.from_arrays([
                    pa.array(fp[rows]), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([bitmap(x, bitmap_bits(len(x))).tobytes() for x in items], pa.binary()),
                    pa.array([packed(x) for x in items], pa.binary())], names=["fp", "n", "bitmap", "items"])

    made = docs.select(F.xxhash64(doc_id), text).mapInArrow(task, "fp long, n long, bitmap binary, items binary")
    return written(made.withColumn("part", F.spark_partition_id()), "candidate-sets")


def sets_of(sets: DataFrame, fps: DataFrame) -> DataFrame:
    """(fp, part, n, items) of the sets whose fingerprints are in ``fps``, and few others: what is not compared
    is left out before the sets are moved."""
    shared = sets.sparkSession.sparkContext.broadcast(fp_filter(fps))

    def task(batches):
        bits = shared.value
        for batch in batches:
            at = _filter_at(batch.column(0).to_numpy())
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7) & 1).astype(bool)))

    narrow = sets.select("fp", "part", "n", "items")
    return written(narrow.mapInArrow(task, narrow.schema), "compared-sets")


def packed(items: np.ndarray) -> bytes:
    """Sorted 56-bit hashes for the way to the comparisons: of a set of up to ``WIDE`` the first 40 bits, in five bytes
    each (2 * WIDE such hashes have an equal pair by chance once in 30,000 comparisons at most); of a larger one all, in seven."""
    if len(items) > WIDE:
        return items.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
    return (items >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` hashes at their place in 56 bits; the last 16 bits of a set sent in five bytes are zero."""
    width = len(raw) // max(n, 1)
    out = np.zeros((n, 8), np.uint8)
    out[:, 7 - width:7] = np.frombuffer(raw, np.uint8).reshape(-1, width) if n else 0
    return out.reshape(-1).view("<u8")


# ---- signature trees ---------------------------------------------------------------------------

def bitmap_bits(n: int) -> int:
    return max(9, min(17, math.ceil(math.log2(4 * max(n, 1)))))


def bitmap(items: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << (bits - 3), np.uint8)
    at = (items & np.uint64((1 << bits) - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.uint64)


def fold(maps: list[np.ndarray], bits: int) -> np.ndarray:
    """Bitmaps at a common width: a wider one's halves are OR-ed (a bit is a hash's last digits)."""
    words = 1 << (bits - 6)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, words), axis=0) for m in maps])


class SignatureTree:
    """Levels of OR-combined bitmaps and size ranges over leaves; level 0 holds the leaves."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray):
        ones = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, sizes - ones)]
        while len(self.levels[-1][0]) > 1:
            m, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
        """False where no leaf below a and leaf below b can have the similarity: the largest overlap that
        sizes and common bits allow is under least / (100 + least) of the sizes' sum.  (Shingles that share
        a bit with another of their set are hidden in the count of common bits.)"""
        maps, low, high, hidden = self.levels[level]
        need = least * (low[a] + low[b])
        ok = np.flatnonzero((100 + least) * np.minimum(high[a], high[b]) >= need)
        ok = ok[(100 * high[a[ok]] >= least * low[b[ok]]) & (100 * high[b[ok]] >= least * low[a[ok]])]
        step = max(1, (1 << 21) // maps.shape[1])
        out = np.zeros(len(a), bool)
        for k in range(0, len(ok), step):
            x = ok[k:k + step]
            common = np.bitwise_count(maps[a[x]] & maps[b[x]]).sum(axis=1).astype(np.int64)
            most = common + np.minimum(hidden[a[x]], hidden[b[x]])
            out[x] = (100 + least) * most >= need[x]
        return out

    def pairs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Dual traversal of the tree with itself: the leaf pairs (a < b) that are left."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            keep = self.possible(level, a, b, least)
            a, b = a[keep], b[keep]
            n = len(self.levels[level - 1][0])
            kids = np.arange(FANOUT)
            a, b = np.repeat(a * FANOUT, FANOUT * FANOUT), np.repeat(b * FANOUT, FANOUT * FANOUT)
            k = np.tile(np.arange(FANOUT * FANOUT), len(a) // (FANOUT * FANOUT))
            a, b = a + kids[k // FANOUT], b + kids[k % FANOUT]
            keep = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
            a, b = a[keep], b[keep]
        keep = (a < b)
        a, b = a[keep], b[keep]
        keep = self.possible(0, a, b, least)
        return a[keep], b[keep]


def _forest(ids: np.ndarray, root: np.ndarray) -> tuple[list, list]:
    """Star edges of the components given by ``root`` (a place in ids for each)."""
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[at].tolist(), ids[root[at]].tolist()


def _join(root: np.ndarray, a: int, others: np.ndarray) -> None:
    """Give the components of a and of others one root, in place."""
    r = np.unique(root[np.append(others, a)])
    root[np.isin(root, r)] = r[0]


def candidate_forest(ids: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], least: int):
    """Spanning forest of the candidate graph of one list."""
    bits = np.array([len(m).bit_length() + 5 for m in maps])
    root = np.arange(len(ids))
    for width in np.unique(bits):  # sets of linked sizes have widths that differ by one at most
        own = np.flatnonzero((bits == width) | (bits == width + 1))
        own = own[np.argsort(sizes[own], kind="stable")]
        if len(own) < 2:
            continue
        tree = SignatureTree(fold([maps[i] for i in own], int(width)), sizes[own])
        a, b = tree.pairs(least)
        a, b = own[a], own[b]
        first = np.minimum(bits[a], bits[b]) == width
        a, b = a[first], b[first]
        for x in np.unique(a):
            _join(root, x, b[a == x])
    return _forest(ids, root)


def link_forest(ids: np.ndarray, items: list[np.ndarray], least: int, labels: np.ndarray | None = None):
    """Spanning forest of the true links among sets; nodes of equal labels count as connected."""
    sizes = np.array([len(x) for x in items], np.int64)
    order = np.argsort(sizes, kind="stable")
    ids, items, sizes = ids[order], [items[i] for i in order], sizes[order]
    start = np.arange(len(ids))
    if labels is not None:
        _, first, inv = np.unique(labels[order], return_index=True, return_inverse=True)
        start = first[inv]
    root = start.copy()
    bits = bitmap_bits(int(sizes.max()))
    a, b = SignatureTree(np.stack([bitmap(x >> np.uint64(16), bits) for x in items]), sizes).pairs(least)
    narrow = sizes <= WIDE
    both = np.concatenate([np.stack([a, b]), np.stack([b, a])], axis=1)
    both = both[:, np.argsort(both[0], kind="stable")]
    hubs, begin, degree = np.unique(both[0], return_index=True, return_counts=True)
    done = np.zeros(len(ids), bool)
    edges = []
    for k in np.argsort(-degree, kind="stable"):  # hubs first: they connect the most, and spare comparisons
        x = int(hubs[k])
        partners = both[1, begin[k]:begin[k] + degree[k]]
        partners = partners[(root[partners] != root[x]) & ~done[partners]]
        done[x] = True
        if not len(partners):
            continue
        flat, n, own = np.concatenate([items[p] for p in partners]), sizes[partners], items[x]
        if narrow[x] or narrow[partners].any():
            flat, own = flat & FIRST_40, own & FIRST_40
        place = np.minimum(np.searchsorted(own, flat), sizes[x] - 1)
        common = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(n) - n)
        linked = partners[100 * common >= least * (n + sizes[x] - common)]
        if len(linked):
            edges += [(int(ids[x]), int(ids[p])) for p in linked[np.unique(root[linked], return_index=True)[1]]]
            _join(root, x, linked)
    return edges


# ---- the join ----------------------------------------------------------------------------------

def _parts(total: int, per: int) -> int:
    return max(1, -(-total // per))


def _by_group(tab: pa.Table, column: str):
    """Places of each group's rows in a table."""
    key = tab.column(column).combine_chunks().to_numpy(zero_copy_only=False)
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, int)
    for lo, hi in zip(cut, np.append(cut[1:], len(key)), strict=True):
        yield order[lo:hi]


def _edge_table(edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in edges], pa.int64()), "b": pa.array([y for _, y in edges], pa.int64())})


def candidates(members: DataFrame, sets: DataFrame, lists: DataFrame, least: int) -> DataFrame:
    """Forest edges of the candidate graph, from all lists.

    Lists of one cluster of copies share most nodes.  They are dealt together, by the largest list of their
    smallest node, so that a node's bitmap goes to a task once and not with each of its lists; many lists of
    one kind are dealt to several tasks of about ``DEAL`` places."""
    small = members.where(F.col("m") <= BLOCK)
    top = small.groupBy("fp").agg(F.max(F.struct("m", "key")).alias("t")).select(F.col("fp").alias("low"), F.col("t.key").alias("top"))
    kinds = lists.where(F.col("m") <= BLOCK).select("key", "m", "low").join(top, "low")
    kinds = written(kinds, "list-kinds")
    salts = kinds.groupBy("top").agg(F.ceil(F.sum("m") / DEAL).alias("salts"))
    tasks = _parts(kinds.agg(F.sum("m")).first()[0] or 0, DEAL)
    dealt = kinds.join(salts, "top").select("key", F.pmod(F.xxhash64("top", F.pmod(F.xxhash64("key"), F.col("salts"))), F.lit(tasks)).alias("deal"))
    places = written(small.select("key", "fp", "part").join(dealt, "key"), "list-places")
    # merge joins at every size: the plan, and what it moves, follows the data alone
    maps = places.select("deal", "fp", "part").distinct().hint("merge").join(sets.select("fp", "part", "n", "bitmap"), ["fp", "part"])
    maps = maps.select(F.col("deal").alias("to"), F.col("fp").alias("node"), "n", "bitmap")

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, n = right.column("node").to_numpy(), right.column("n").to_numpy()
        maps = [np.frombuffer(x, np.uint64) for x in right.column("bitmap").to_pylist()]
        order = np.argsort(ids, kind="stable")
        at = order[np.searchsorted(ids[order], left.column("fp").to_numpy())] if len(ids) else np.zeros(0, np.int64)
        edges = []
        for rows in _by_group(left, "key"):
            nodes = at[rows]
            edges += zip(*candidate_forest(ids[nodes], n[nodes], [maps[i] for i in nodes], least), strict=True)
        return _edge_table(edges)

    found = places.groupBy("deal").cogroup(maps.groupBy("to")).applyInArrow(task, "a long, b long")
    unseen = members.where(F.col("m") > BLOCK).select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return found.unionAll(unseen)


def _meet(units: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links found in each unit (unit, fp, part, label): a bounded number of nodes that are compared in one task."""
    rows = units.hint("merge").join(sets.select("fp", "part", "n", "items"), ["fp", "part"])
    total = units.count()
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("unit"), F.lit(_parts(total, 1000))))

    def task(tab):
        ids, label = tab.column("fp").to_numpy(), tab.column("label").to_numpy()
        raw, n = tab.column("items").to_pylist(), tab.column("n").to_pylist()
        edges = []
        for at in _by_group(tab, "unit"):
            edges += link_forest(ids[at], [unpacked(raw[i], n[i]) for i in at], least, label[at])
        return _edge_table(edges)

    return written(dealt.groupBy("deal").applyInArrow(task, "a long, b long"), "links")


def links(groups: DataFrame, picks: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Links that connect the nodes of each candidate group (node, root), as a forest and some edges more."""
    nodes = written(groups.join(picks.withColumnRenamed("fp", "node"), "node"), "candidate-nodes")
    sets = sets_of(sets, nodes.select("node"))
    size = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    blocks = size.select("root", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    first = nodes.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # every block meets block 0: its nodes go to all units, others' to their own
    unit = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("block") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))
    units = first.select(F.col("node").alias("fp"), "part", F.col("node").alias("label"), "root", F.explode(unit).alias("u"))
    units = units.select(F.xxhash64("root", "u").alias("unit"), "fp", "part", "label")
    found = _meet(units, sets, least)
    several = blocks.where("blocks > 1").select("root", "blocks")
    if several.isEmpty():
        return found
    # second meeting, only in groups of several blocks: M is the largest component so far, S the rest
    named = components(found).withColumnRenamed("root", "label")
    labelled = written(nodes.join(several, "root").join(named, "node", "left").select(
        "root", "node", "part", "n", F.coalesce("label", "node").alias("label")), "candidate-labels")
    by_label = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    largest = by_label.groupBy("root").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"), F.sum("s").alias("alls"))
    s = by_label.join(largest.select("root", "top.label"), ["root", "label"]).select("root", F.col("s").alias("tops"))
    sides = largest.join(s, "root").select("root", F.col("top.label").alias("main"),
                                           (F.col("all") - F.col("top.m")).alias("s_m"), (F.col("alls") - F.col("tops")).alias("s_s"),
                                           F.col("top.m").alias("m_m"), F.col("tops").alias("m_s")).where("s_m > 0")
    count = lambda m, k: F.greatest(F.lit(1), F.ceil(F.col(m) / BLOCK), F.ceil(F.col(k) / BLOCK_SHINGLES)).cast("int")
    sides = sides.select("root", "main", count("s_m", "s_s").alias("sb"), count("m_m", "m_s").alias("mb"))
    dealt = labelled.join(sides, "root").withColumn("rest", F.col("label") != F.col("main"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("rest"), F.col("sb")).otherwise(F.col("mb"))).cast("int"))
    s_units = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda j: F.struct(F.lit("s").alias("kind"), F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))),
        F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda j: F.struct(F.lit("m").alias("kind"), F.col("block").alias("i"), j.alias("j"))))
    m_units = F.transform(F.sequence(F.lit(0), F.col("sb") - 1), lambda i: F.struct(F.lit("m").alias("kind"), i.alias("i"), F.col("block").alias("j")))
    units = dealt.select(F.col("node").alias("fp"), "part", "label", "root", F.explode(F.when(F.col("rest"), s_units).otherwise(m_units)).alias("u"))
    units = units.select(F.xxhash64("root", "u.kind", "u.i", "u.j").alias("unit"), "fp", "part", "label")
    return found.unionAll(_meet(written(units, "second-units"), sets, least))


def different_lists(shared: DataFrame) -> DataFrame:
    """(m, sig, low, key) of the lists of two nodes or more; equal lists are taken once.  A list's signature is
    its size and the exclusive or of its members' hashes, which no number of members takes out of range."""
    sig = F.bit_xor(F.xxhash64("fp"))
    lists = shared.groupBy("key").agg(F.count(F.lit(1)).alias("m"), sig.alias("sig"), F.min("fp").alias("low")).where("m > 1")
    return lists.groupBy("m", "sig", "low").agg(F.min("key").alias("key"))


def possible_members(members: DataFrame) -> DataFrame:
    """(key, fp, m, low) of ``members`` (key, fp, n, most, m, low) without those that no other node of their list can be
    linked with by sizes and places, equal lists once.  Lists of more than ``BLOCK`` nodes stay as they are.

    All that two sets have in common comes from their first common shingle on, and its list is the first of all
    lists that hold both, so this list keeps them; equal lists go by their first shingle, which is the first here too."""
    small = members.where(F.col("m") <= BLOCK).groupBy("key").agg(F.collect_list(F.struct("fp", "n", "most")).alias("r"))
    fits = lambda x, y: (x.fp != y.fp) & (y.n <= x.most) & (x.n <= y.most)
    kept = small.select("key", F.filter("r", lambda x: F.exists("r", lambda y: fits(x, y))).alias("r")).where(F.size("r") > 0)
    kept = kept.groupBy(F.array_sort("r.fp").alias("fps")).agg(F.min("key").alias("key"))
    kept = kept.select("key", F.explode("fps").alias("fp"), F.size("fps").cast("long").alias("m"), F.col("fps")[0].alias("low"))
    return kept.unionByName(members.where(F.col("m") > BLOCK).select("key", "fp", "m", "low"))


def near_duplicates(docs: DataFrame, width: int = 5, least: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the component of every document.  Links are compared as far as
    components need them, so they are neither counted nor put out."""
    sets, counts = set_table(docs, width, doc_id, text)
    owners = Owners(sets)
    routed = written(routes(docs, counts, width, least, owners, doc_id, text), "routes")
    sizes = routed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    sizes = written(sizes.select("key"), "shared-keys")  # a join of two tables, whose hot keys Spark can split
    shared = written(routed.join(sizes, "key").distinct(), "shared-routes")
    lists = written(different_lists(shared), "lists")
    members = written(shared.join(lists.select("key", "m", "low"), "key"), "list-members")
    members = written(possible_members(members), "members")
    lists = members.select("key", "m", "low").distinct()
    nodes = node_sets(docs, members.select("fp"), width, owners, doc_id, text)
    picks = written(nodes.groupBy("fp").agg(F.min(F.struct("part", "n")).alias("p")).select("fp", "p.part", "p.n"), "picks")
    members = members.join(picks.select("fp", "part"), "fp")
    groups = components(candidates(members, nodes, lists, least))
    linked = components(links(groups, picks, nodes, least))
    # names: the smallest doc_id of a set, then of a component of sets
    of_set = sets.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("own"))
    of_set = written(of_set.join(linked.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "set-names")
    names = of_set.groupBy("root").agg(F.min("own").alias("component_id"))
    by_fp = written(of_set.select("fp", "root").join(names, "root").select("fp", "component_id"), "component-names")
    out = sets.join(by_fp, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

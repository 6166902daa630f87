"""Vector code compression by product quantisation with active-entry Lloyd rounds (operator 13).

Vectors become whole numbers and are cut into equal parts; each part position has a codebook.  A round is one pass:
every part is assigned to its nearest entry, and the same tasks add up the parts of each entry, so that the new
codebooks come from a few sums a task.  Between rounds a row keeps its codes and their exact squared distances:

* a part whose entry did not move in the last update compares its stored distance with the moved entries only.
  An entry that stayed can't have come nearer, so the best is the old one or a moved one; at equal distance the
  lower index wins, as in a full scan;
* a part whose entry moved compares all entries.

All numbers are integers, so the outcome doesn't depend on the order or the number of tasks.  The table of a round
replaces that of the round before, which is deleted once the new one is complete.

Defined cases: rows with a null or empty vector, or with null or non-finite components, or of another length than
most (of equally frequent lengths, the smallest) are dropped; a null vec_id comes last among the first entries,
rows of equal vec_id there go by their numbers, then labels; with fewer rows than entries the codebooks have as many entries as rows;
repeated rows count each; an empty table gives an empty result; extra columns are ignored.  A length that the
number of parts doesn't divide, and squared distances beyond 64 bits, stop the query.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcorpus.llm.common import forget, hot_join, shared_folder, written

#: Rows whose distances one numpy step holds.
STEP = 4096
_STATE = "vec_id long, label long, v array<long>, code binary, dist array<long>"
_ROUND = _STATE + ", part int, entry int, n long, sums array<long>"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) in int64."""
    out = np.empty((len(x), len(entries)), np.int64)
    for e, entry in enumerate(entries):
        diff = x - entry
        out[:, e] = np.einsum("ij,ij->i", diff, diff)
    return out


def assign(x: np.ndarray, books: np.ndarray, code: np.ndarray | None = None, dist: np.ndarray | None = None,
           moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code, dist), both (rows, parts): each part's nearest entry, the lowest of equals, and its squared distance.
    With the ``code`` and ``dist`` of the last round and the entries ``moved`` since, only what may have changed is compared."""
    parts, _, width = books.shape
    new_code, new_dist = np.empty((2, len(x), parts), np.int64)
    for p in range(parts):
        body = x[:, p * width:(p + 1) * width]
        if code is None:
            whole = np.arange(len(x))
        else:
            gone = moved[p][code[:, p]]
            whole, stay = np.flatnonzero(gone), np.flatnonzero(~gone)
            new_code[stay, p], new_dist[stay, p] = code[stay, p], dist[stay, p]
            active = np.flatnonzero(moved[p])
            if len(active) and len(stay):
                d = distances(body[stay], books[p][active])
                near = d.argmin(axis=1)  # the first of equals, and ``active`` ascends
                best, entry = d[np.arange(len(stay)), near], active[near]
                better = (best < dist[stay, p]) | ((best == dist[stay, p]) & (entry < code[stay, p]))
                new_code[stay[better], p], new_dist[stay[better], p] = entry[better], best[better]
        if len(whole):
            d = distances(body[whole], books[p])
            near = d.argmin(axis=1)
            new_code[whole, p], new_dist[whole, p] = near, d[np.arange(len(whole)), near]
    return new_code, new_dist


def _numbers(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, width)


def _round(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows with new codes and distances and, after the rows of a task, its sums for each (part, entry)."""
    parts, entries, width = books.shape

    def task(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, STEP):
                b = batch.slice(lo, STEP)
                x = _numbers(b.column(2), parts * width)
                if moved is None:
                    code, dist = assign(x, books)
                else:
                    old = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint16).reshape(-1, parts).astype(np.int64)
                    code, dist = assign(x, books, old, _numbers(b.column(4), parts), moved)
                for p in range(parts):
                    count[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(total[p], code[:, p], x[:, p * width:(p + 1) * width])
                n = len(x)
                raw, flat = code.astype(np.uint16), pa.array(np.ascontiguousarray(dist).ravel())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array([r.tobytes() for r in raw], pa.binary()),
                     pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * parts, flat),
                     *[pa.nulls(n, t) for t in types[5:]]], names=names)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(p), t) for t in types[:5]], pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)),
                                          pa.array(count[p, e]), pa.array(list(total[p, e]), types[8])], names=names)

    names = ["vec_id", "label", "v", "code", "dist", "part", "entry", "n", "sums"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    return state.mapInArrow(task, _ROUND)


def _updated(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each used entry becomes the floor of the mean of its parts, component by component."""
    long = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "x"))
    means = long.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # one row a component of the codebooks
    out = books.copy()
    for r in means:
        out[r.part, r.entry, r.pos] = r.x // r.n
    return out


def train_and_encode(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0,
                     vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, dist), codebooks): code holds 16-bit indexes in part order, dist each part's squared
    distance; codebooks are (parts, entries, numbers).  An empty table gives no codebook entries."""
    spark = rows.sparkSession
    x = F.col(embedding).cast("array<double>")
    kept = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), x.alias("x")).where("size(x) > 0").where(
        F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    numbers = F.transform("x", lambda c: F.floor(F.lit(scale) * c))
    kept = kept.select("vec_id", "label", numbers.alias("v"), F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<long>").alias("dist"))
    size = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("top"))
    size = size.orderBy(F.desc("n"), "d").limit(1).collect()
    if not size:
        return kept.select("vec_id", "label", "code", "dist"), np.zeros((parts, 0, 0), np.int64)
    dim, top = size[0].d, size[0].top
    if dim % parts:
        raise ValueError(f"vectors of {dim} numbers can't be cut into {parts} equal parts")
    if dim * (2 * top + 1) ** 2 >= 1 << 63:
        raise ValueError(f"squared distances of {dim} numbers up to {top} don't fit 64 bits")
    kept = kept.where(F.size("v") == dim)
    first = kept.select("vec_id", "v", "label").orderBy(F.asc_nulls_last("vec_id"), "v", "label").limit(entries).collect()
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    state, moved, path = kept, None, None
    for _ in range(rounds + 1):
        last, path = path, f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
        _round(state, books, moved).write.parquet(path)
        if last:
            forget(spark, last)
        done = spark.read.schema(_ROUND).parquet(path)
        state = done.where("part IS NULL").select("vec_id", "label", "v", "code", "dist")
        if _ < rounds:
            new = _updated(done.where("part IS NOT NULL").select("part", "entry", "n", "sums"), books)
            moved, books = (new != books).any(axis=2), new
    return state.select("vec_id", "label", "code", "dist"), books


def compress(rows: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the codes as two hex digits each, the sum of a row's
    squared distances, the sum of that over the rows of its label, and the digest of the codebooks' numbers."""
    coded, books = train_and_encode(rows, **options)
    parts = books.shape[0]
    if books.shape[1] > 256:
        raise ValueError("two hex digits hold 256 entries")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    low_bytes = F.concat(*[F.substring(F.lower(F.hex("code")), 4 * p + 1, 2) for p in range(parts)])  # little-endian pairs
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d)
    key = F.coalesce(F.col("label").cast("string"), F.lit(""))
    coded = written(coded.select("vec_id", key.alias("_label"), low_bytes.alias("code"), error.alias("error")), "codes")
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return hot_join(coded, written(sums, "label-errors"), "_label").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

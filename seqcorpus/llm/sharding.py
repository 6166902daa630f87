"""Reproducible shuffle into shards by a Feistel permutation of global row numbers (operator 8).

Rows get gapless numbers 0..N-1 in the order of their keys.  A Feistel network over Z_a x Z_b, with
a = ceil(sqrt N) and b = ceil(N / a), permutes 0..a*b-1; cycle walking (applying it again while the value
is N or more) makes that a permutation of 0..N-1.  Value p goes to shard p mod S, slot p div S: shards
differ by one row at most, slots are gapless, and :func:`place` computes both from N, the seed and the row
number alone, as :func:`row_at` does the way back.  Only keys are sorted and written, never the texts.

Defined cases: a null text has size 16 and the checksum of the empty text; null keys sort first; rows equal
in all keys take neighbouring numbers in either order; an empty table gives an empty result; extra
columns are ignored.  A hot key is no group here: range partitioning sorts on the whole key.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcorpus.llm.common import written

ROUNDS = 8
#: a*b exceeds N by less than sqrt N, so a step leaves 0..N-1 with chance below 1/sqrt N; a walk of this
#: many steps is never seen, and would raise an error rather than misplace a row.
WALK = 64
_LOCAL = 33


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def feistel(value, n: int, seed: int):
    """One application to a bigint column of values below a*b."""
    a, b = sides(n)
    step = lambda s, k: F.when(
        k % 2 == 0, F.struct(F.pmod(s.l + F.pmod(F.xxhash64(s.r, k, F.lit(seed).cast("long")), F.lit(a)), F.lit(a)).alias("l"), s.r.alias("r"))
    ).otherwise(
        F.struct(s.l.alias("l"), F.pmod(s.r + F.pmod(F.xxhash64(s.l, k, F.lit(seed).cast("long")), F.lit(b)), F.lit(b)).alias("r")))
    start = F.struct(F.pmod(value, F.lit(a)).cast("long").alias("l"), F.floor(value / F.lit(a)).cast("long").alias("r"))
    rounds = F.array(*[F.lit(k).cast("long") for k in range(ROUNDS)])
    return F.aggregate(rounds, start, step, lambda s: s.r * F.lit(a).cast("long") + s.l)


def permuted(number, n: int, seed: int):
    """The permutation of 0..n-1 at a row number column."""
    walk = F.array(*[F.lit(k) for k in range(WALK)])
    first = feistel(number, n, seed)
    end = F.aggregate(walk, first, lambda v, _: F.when(v < n, v).otherwise(feistel(v, n, seed)))
    return F.when(end < n, end).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def row_numbers(df: DataFrame, keys: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Gapless row numbers in the order of ``keys`` (which should tell rows apart), and the row count.

    A range-sorted table is written with in-partition places; the offsets are one row a partition."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "row-numbers")
    part = F.shiftright("_id", _LOCAL)
    counts = sorted((r._p, r.n) for r in placed.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    small = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_p long, _off long"))
    local = F.col("_id").bitwiseAND(F.lit((1 << _LOCAL) - 1))
    out = placed.withColumn("_p", part.cast("long")).join(small, "_p").withColumn(name, F.col("_off") + local)
    return out.drop("_p", "_off", "_id"), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row number, shard and slot of every document, with its size and text checksum."""
    body = F.coalesce(F.col(text), F.lit(""))
    keys = docs.select(F.col(doc_id), (F.octet_length(body) + 16).cast("long").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    keys = written(keys, "shard-keys")  # the texts are read once; range sampling reads only this
    numbered, n = row_numbers(keys, [doc_id, "text_crc32", "size"])
    p = numbered.withColumn("_p", permuted(F.col("row_number"), n, seed))
    return p.select(doc_id, "size", "text_crc32", F.lit("rows").alias("law"),
                    F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
                    F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "row_number")


def _hash(x: int, k: int, seed: int) -> int:
    """Spark's xxhash64 of three bigints."""
    import xxhash

    h = 42
    for v in (x, k, seed):
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def _network(v: int, n: int, seed: int, back: bool) -> int:
    a, b = sides(n)
    left, right = v % a, v // a
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2 == 0:
            left = (left + sign * (_hash(right, k, seed) % a)) % a
        else:
            right = (right + sign * (_hash(left, k, seed) % b)) % b
    return right * a + left


def place(number: int, n: int, shards: int = 40, seed: int = 8) -> tuple[int, int]:
    """Shard and slot of a row number, computed outside Spark."""
    v = _network(number, n, seed, False)
    while v >= n:
        v = _network(v, n, seed, False)
    return v % shards, v // shards


def row_at(shard_no: int, slot: int, n: int, shards: int = 40, seed: int = 8) -> int:
    """The row number at a shard and slot."""
    v = _network(slot * shards + shard_no, n, seed, True)
    while v >= n:
        v = _network(v, n, seed, True)
    return v

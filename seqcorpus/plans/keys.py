"""Order keys that keep aggregations hash-based.

``min(struct(...))`` has a non-fixed-width buffer and forces a sort-based aggregate.  When the
order columns are non-negative integers whose digit widths add up to <= 38, the same
lexicographic order is one BIGINT or DECIMAL(38,0) value, which hash aggregation updates in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DIGITS = 38
LONG_DIGITS = 18


def digit_widths(df: DataFrame, cols: list[str]) -> list[int] | None:
    """Decimal digits needed per column (one scalar aggregate), or None if some value is
    negative / null-only or the widths do not fit 38 digits."""
    row = df.agg(*[F.max(c).alias(f"mx{i}") for i, c in enumerate(cols)],
                 *[F.min(c).alias(f"mn{i}") for i, c in enumerate(cols)]).first()
    widths = []
    for i in range(len(cols)):
        mx, mn = row[f"mx{i}"], row[f"mn{i}"]
        if mx is None:
            mx, mn = 0, 0
        if mn < 0:
            return None
        widths.append(len(str(int(mx))))
    return widths if sum(widths) <= MAX_DIGITS else None


def packed_key(cols: list, widths: list[int]) -> Column:
    """A number whose order equals the lexicographic order of ``cols``: BIGINT arithmetic up to 18 digits,
    else a DECIMAL(38,0) read from the padded digits (decimal products would overflow their type)."""
    columns = [F.col(c) if isinstance(c, str) else c for c in cols]
    if sum(widths) <= LONG_DIGITS:
        key = F.lit(0).cast("long")
        for c, w in zip(columns, widths):
            key = key * F.lit(10 ** w).cast("long") + c.cast("long")
        return key
    return F.concat(*[F.lpad(c.cast("string"), w, "0") for c, w in zip(columns, widths)]).cast("decimal(38,0)")


def unpack_key(key, widths: list[int], names: list[str]) -> list[Column]:
    """Inverse of ``packed_key`` (columns as BIGINT): the key's digits, cut by widths."""
    k = F.col(key) if isinstance(key, str) else key
    digits = F.lpad(k.cast("string"), sum(widths), "0")
    out, at = [], 1
    for w, n in zip(widths, names):
        out.append(F.substring(digits, at, w).cast("long").alias(n))
        at += w
    return out

"""Training-log analytics: SRC-16 (parse), WIN-12 (running best), AGG-22..24 (meters).

A log line is one of: ``| epoch 001:   1000 / 3233 k=v, k=v`` (mid-epoch), ``| epoch 001 | k v |
k v`` (epoch end), ``| epoch 001 | valid on 'valid' subset | k v | ...`` or a JSON object.  Keys
are dynamic: metrics land in a ``MAP<STRING,STRING>`` and the common ones are typed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: line patterns of the progress printer ---------------------------------
MID_RE = r"^\| epoch (\d+):\s+(\d+) / (\d+) (.*)$"
VALID_RE = r"^\| epoch (\d+) \| valid on '([^']+)' subset \| (.*)$"
END_RE = r"^\| epoch (\d+) \| (.*)$"


def parse_train_log(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """SRC-16: ``kind, epoch, step, total, subset, metrics`` + typed loss/ppl/num_updates/wall."""
    t = F.col(text_col)
    is_mid, is_valid, is_end = t.rlike(MID_RE), t.rlike(VALID_RE), t.rlike(END_RE)
    is_json = F.trim(t).startswith("{")
    kind = (F.when(is_mid, "train_inner").when(is_valid, "valid").when(is_end, "train")
            .when(is_json, "json").otherwise(None))
    body = (F.when(is_mid, F.regexp_extract(t, MID_RE, 4)).when(is_valid, F.regexp_extract(t, VALID_RE, 3))
            .when(is_end, F.regexp_extract(t, END_RE, 2)))
    kv_mid = F.transform(F.split(body, ", "), lambda x: F.split(x, "="))
    kv_bar = F.transform(F.split(body, r" \| "), lambda x: F.split(x, " "))
    kv = F.when(is_mid, kv_mid).otherwise(kv_bar)
    metrics = F.when(is_json, F.from_json(t, "map<string,string>")).otherwise(
        F.map_from_entries(F.transform(F.filter(kv, lambda p: F.size(p) == 2), lambda p: F.struct(p[0], p[1]))))
    epoch = F.nullif(F.regexp_extract(t, r"^\| epoch (\d+)", 1), F.lit("")).cast("int")
    out = lines.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "*", epoch.alias("epoch"),
        F.when(is_mid, F.regexp_extract(t, MID_RE, 2).cast("long")).alias("step"),
        F.when(is_mid, F.regexp_extract(t, MID_RE, 3).cast("long")).alias("total"),
        F.when(is_valid, F.regexp_extract(t, VALID_RE, 2)).alias("subset"),
        metrics.alias("metrics"))
    m = F.col("metrics")
    return out.select("*", F.coalesce(m["loss"], m["valid_loss"]).cast("double").alias("loss"),
                      F.coalesce(m["ppl"], m["valid_ppl"]).cast("double").alias("ppl"),
                      m["num_updates"].cast("long").alias("num_updates"), m["wall"].cast("long").alias("wall"))


def running_best(valid: DataFrame, run_cols: list[str], order_col: str = "epoch", loss_col: str = "loss") -> DataFrame:
    """WIN-12: min validation loss so far and a ``is_best`` flag when strictly lower than all before
    (window per run: a run's validations are one row per epoch)."""
    w = Window.partitionBy(*run_cols).orderBy(order_col)
    before = F.min(loss_col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return valid.withColumn("best_so_far", F.least(F.coalesce(before, F.col(loss_col)), F.col(loss_col))).withColumn(
        "is_best", before.isNull() | (F.col(loss_col) < before))


def aggregate_logs(outputs: DataFrame, group_cols: list[str], sums: list[str] | None = None,
                   derived: dict[str, Column] | None = None) -> DataFrame:
    """AGG-22: sums over workers, and what follows from them: by default loss, nll, ntokens, nsentences and sample_size, and the losses
    per token in bits.  A task of its own names its ``sums`` and gives ``derived`` columns as expressions over them."""
    agg = outputs.groupBy(*group_cols).agg(*[F.sum(c).alias(c) for c in sums or ("loss", "nll_loss", "ntokens", "nsentences", "sample_size")])
    bits = {"loss_bits": F.col("loss") / F.col("sample_size") / F.lit(math.log(2)), "nll_bits": F.col("nll_loss") / F.col("ntokens") / F.lit(math.log(2))}
    return agg.withColumns(derived or ({} if sums else bits))


def weighted_average_meter(df: DataFrame, group_cols: list[str], value: str, n: str, ts: str) -> DataFrame:
    """AGG-23: ``sum(v*n)/sum(n)`` and the last value."""
    return df.groupBy(*group_cols).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("avg"),
                                       F.max_by(value, ts).alias("last"), F.sum(n).alias("count"))


def rate_meter(df: DataFrame, group_cols: list[str], n: str, ts: str) -> DataFrame:
    """AGG-24: events per elapsed second, and mean seconds between events (stopwatch)."""
    sec = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    secs = F.max(sec) - F.min(sec)
    return df.groupBy(*group_cols).agg(F.sum(n).alias("n"), secs.alias("elapsed"),
                                       (F.sum(n) / secs).alias("rate"), (secs / F.sum(n)).alias("sec_per_unit"))

"""Scores of given targets by a user's model: SCR-01.

``load_model()`` is called once a Python worker and gives ``model_fn(batch)``; a batch is a dict of padded arrays ``target``,
``prev`` (the target shifted, eos first), ``lengths``, and ``source`` if there is one.  It returns log-probabilities, either of the given
target tokens (rows, positions) or of the whole vocabulary (rows, positions, V), which are then gathered (JN-09).
Rows are sorted by length within their partition, so that batches of at most ``max_tokens`` padded tokens waste little.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcorpus.constants import EOS, PAD


def _loaded(key: str, load_model: Callable):
    """The worker's own copy of the model, kept for all tasks that the worker runs."""
    held = sys.__dict__.setdefault("_seqcorpus_models", {})
    if key not in held:
        held[key] = load_model()
    return held[key]


def _padded(values: np.ndarray, sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``sizes`` values as a padded array, and where its values are."""
    here = np.arange(sizes.max(initial=0)) < sizes[:, None]
    out = np.full(here.shape, pad, np.int64)
    out[here] = values
    return out, here


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, values) of an Arrow array of lists."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def score_reference(rows: DataFrame, key_cols: list[str], load_model: Callable, target: str = "ids", source: str | None = None,
                    max_tokens: int = 1 << 16, eos: int = EOS, pad: int = PAD) -> DataFrame:
    """SCR-01: ``(keys, tokens, lps)``: the log-probability of every token of the target.  A null or empty target has no positions."""
    key = uuid.uuid4().hex
    ids = [F.coalesce(F.col(c).cast("array<int>"), F.expr("CAST(array() AS ARRAY<INT>)")) for c in (target, *([source] if source else []))]
    sent = rows.select(*key_cols, *[c.alias(n) for c, n in zip(ids, ("tokens", "_source"))]).sortWithinPartitions(F.size("tokens"))
    n = len(key_cols)

    def task(batches):
        model = None
        for batch in batches:
            at, targets = _flat(batch.column(n))
            of, sources = _flat(batch.column(n + 1)) if source else (None, None)
            sizes, lps = np.diff(at), np.empty(len(targets))
            lo = 0
            while lo < len(sizes):
                # rows come by rising length within a partition, so the last row of a batch is its longest
                rows = max_tokens // max(sizes[lo], 1)
                tops = np.maximum.accumulate(sizes[lo:lo + max(rows, 1)])
                over = tops * np.arange(1, len(tops) + 1) > max_tokens
                hi = lo + max(int(over.argmax()) if over.any() else len(tops), 1)
                tgt, here = _padded(targets[at[lo]:at[hi]], sizes[lo:hi], pad)
                if tgt.size:
                    model = model or _loaded(key, load_model)
                    prev = np.concatenate([np.full((hi - lo, 1), eos), tgt[:, :-1]], axis=1)
                    asked = {"target": tgt, "prev": prev, "lengths": sizes[lo:hi]}
                    if source:
                        asked["source"] = _padded(sources[of[lo]:of[hi]], np.diff(of[lo:hi + 1]), pad)[0]
                    got = np.asarray(model(asked), np.float64)
                    if got.ndim == 3:
                        got = np.take_along_axis(got, tgt[:, :, None], axis=2)[:, :, 0]
                    lps[at[lo]:at[hi]] = got[here]
                lo = hi
            scored = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(lps, pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(n + 1)], scored], names=[*key_cols, "tokens", "lps"])

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in sent.schema.fields[:n])
    return sent.mapInArrow(task, f"{keys}tokens array<int>, lps array<double>")


def positional(scored: DataFrame, key_cols: list[str]) -> DataFrame:
    """``(keys, pos, token, lp)``, a row a position: the form that AGG-14 to AGG-18 take."""
    rows = scored.select(*key_cols, "lps", F.posexplode("tokens").alias("pos", "token"))
    return rows.select(*key_cols, "pos", "token", F.get("lps", F.col("pos")).alias("lp"))

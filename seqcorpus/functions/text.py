"""Row-local column expressions on text (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqcorpus.constants import BPE_SYMBOL, LINE_BREAK, UNK_WORD, WS_RUN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize(col) -> Column:
    """PRJ-01: collapse whitespace runs (the 29 Python whitespace code points), strip, split."""
    return F.filter(F.split(_c(col), WS_RUN), lambda x: x != F.lit(""))


def arrow_words(texts):
    """PRJ-01 on an Arrow array of strings: (offsets from 0, words).  Arrow splits at the same 29 code points; a null has no words.
    It looks at what follows trailing whitespace, beyond the buffer for the last text: so one more text is put there."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.utf8_split_whitespace(pa.concat_arrays([texts, pa.array(["."], texts.type)]))
    offsets, words = np.asarray(lists.offsets, dtype=np.int64)[:-1], lists.flatten()[:-1]
    offsets = offsets - offsets[0]
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not full.all():
        offsets, words = np.concatenate([[0], np.cumsum(full)])[offsets], words.filter(full)
    return offsets, words


def split_lines(col) -> Column:
    """Break a text value into lines the way Python's built-in ``open`` does (\\n, \\r, \\r\\n)."""
    return F.when(F.contains(_c(col), F.lit("\r")), F.split(_c(col), LINE_BREAK)).otherwise(F.split(_c(col), "\n"))


def remove_bpe(col, symbol: str = BPE_SYMBOL) -> Column:
    """PRJ-07: ``(text + ' ').replace(symbol, '').rstrip()``."""
    return F.rtrim(F.replace(F.concat(_c(col), F.lit(" ")), F.lit(symbol), F.lit("")))


def mask_digits(col) -> Column:
    """PRJ-15: ASCII digits become '#'."""
    return F.regexp_replace(_c(col), "[0-9]", "#")


def unk_to_UNK(col) -> Column:
    """PRJ-16: '<unk>' becomes 'UNK' before ROUGE."""
    return F.replace(_c(col), F.lit(UNK_WORD), F.lit("UNK"))


def strip_nonprinting(col) -> Column:
    """PRJ-18 (first half): control/format/unassigned code points become a space."""
    return F.regexp_replace(_c(col), r"\p{C}", " ")


# --- fixed values: punctuation normalisation applied before tokenising (a documented short list)
PUNCT_REPLACEMENTS = [
    ("„", '"'), ("“", '"'), ("”", '"'), ("«", '"'), ("»", '"'),
    ("‘", "'"), ("’", "'"), ("‚", "'"), ("`", "'"), ("''", '"'),
    ("–", "-"), ("—", " - "), ("…", "..."), (" ", " "),
]


def normalize_punct(col) -> Column:
    """PRJ-18 (second half): quote/dash/space normalisation, then collapse repeated spaces."""
    out = _c(col)
    for a, b in PUNCT_REPLACEMENTS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, " +", " ")


def lowercase(col) -> Column:
    """PRJ-14."""
    return F.lower(_c(col))


def chars_as_words(col) -> Column:
    """PRJ-19 helper: every non-space character becomes its own word."""
    return F.filter(F.split(F.regexp_replace(_c(col), WS_RUN, ""), ""), lambda x: x != F.lit(""))


def join_tokens(col) -> Column:
    return F.array_join(_c(col), " ")


def ids_to_string(col) -> Column:
    """Render an ARRAY<INT> as space-separated text (the form the reference prints)."""
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), " ")

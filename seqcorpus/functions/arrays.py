"""Row-local array expressions on id sequences (PRJ-03/04/08..12/17/20/23)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqcorpus.constants import EOS, PAD


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def reverse_order(col) -> Column:
    """PRJ-03: reverse the word order (before eos is appended)."""
    return F.reverse(_c(col))


def append_eos(col, eos: int = EOS) -> Column:
    """PRJ-04."""
    return F.concat(_c(col), F.array(F.lit(eos)))


def strip_pad(col, pad: int = PAD) -> Column:
    """PRJ-08: remove every pad id."""
    return F.array_remove(_c(col), pad)


def pad_to(col, n, left: bool, pad: int = PAD) -> Column:
    """PRJ-09: pad to length ``n`` (int or Column) on the left or right."""
    n = F.lit(n) if isinstance(n, int) else _c(n)
    fill = F.array_repeat(F.lit(pad), F.greatest(n - F.size(_c(col)), F.lit(0)))
    return F.concat(fill, _c(col)) if left else F.concat(_c(col), fill)


def shift_eos_first(col, eos: int = EOS) -> Column:
    """PRJ-10: move the final eos to the front (decoder input).  Null when the last id is not eos."""
    c = _c(col)
    return F.when(F.element_at(c, -1) == eos,
                  F.concat(F.array(F.lit(eos)), F.slice(c, 1, F.size(c) - 1)))


def count_left_pads(col, pad: int = PAD) -> Column:
    c = _c(col)
    # index of first non-pad (1-based) minus one; all-pad rows count fully
    firsts = F.filter(F.sequence(F.lit(1), F.size(c)), lambda i: F.element_at(c, i) != pad)
    return F.coalesce(F.element_at(firsts, 1) - 1, F.size(c))


def count_right_pads(col, pad: int = PAD) -> Column:
    return count_left_pads(F.reverse(_c(col)), pad)


def convert_padding_direction(col, left_to_right: bool, pad: int = PAD) -> Column:
    """PRJ-11: rotate pads from one side to the other (rows without pads stay unchanged)."""
    c = _c(col)
    if left_to_right:
        k = count_left_pads(c, pad)
        return F.concat(F.slice(c, k + 1, F.size(c)), F.slice(c, 1, k))
    k = count_right_pads(c, pad)
    n = F.size(c)
    return F.when(k == 0, c).otherwise(F.concat(F.slice(c, n - k + 1, n), F.slice(c, 1, n - k)))


def make_positions(col, left_pad: bool, pad: int = PAD) -> Column:
    """PRJ-12: non-pad positions numbered from pad+1; pads keep the pad value."""
    c = _c(col)
    if left_pad:
        k = count_left_pads(c, pad)
        return F.transform(c, lambda x, i: F.when(x == pad, F.lit(pad)).otherwise(i - k + pad + 1))
    return F.transform(c, lambda x, i: F.when(x == pad, F.lit(pad)).otherwise(i + pad + 1))


def first_n(col, n: int) -> Column:
    """PRJ-17 / PRJ-20: first n items."""
    return F.slice(_c(col), 1, n)


def num_tokens(src_len, tgt_len=None) -> Column:
    """PRJ-23: batching cost = max(src_len, tgt_len or 0)."""
    if tgt_len is None:
        return _c(src_len)
    return F.greatest(_c(src_len), F.coalesce(_c(tgt_len), F.lit(0)))


def effective_max_positions(dataset_cap: int | None, model_cap: int | None, default: int = 1024) -> int:
    """PRJ-21: min of the caps that are set (a plain value, folded as a literal)."""
    caps = [c for c in (dataset_cap, model_cap) if c is not None]
    return min(caps) if caps else default


def band_labels(token, cutoffs: list[int], vocab_size: int):
    """PRJ-13: (head_label, band, tail_label) of a token id under frequency-band cutoffs.

    Ids below cutoffs[0] keep their id as head label (band 0, no tail label).  Band i+1 holds
    cutoffs[i] <= id < cutoffs[i+1]; its head label is ``cutoffs[0] + i - 1`` and its tail label
    ``id - cutoffs[i]``.  The vocabulary size is appended as the last cutoff when larger."""
    if max(cutoffs) > vocab_size:
        raise ValueError(f"a band may not begin behind the vocabulary's end ({vocab_size})")
    bounds = sorted({*cutoffs, vocab_size})
    token, shortlist = _c(token), bounds[0]
    head, band, tail = F.when(token < shortlist, token), F.when(token < shortlist, F.lit(0)), None
    for k, (low, high) in enumerate(zip(bounds, bounds[1:]), start=1):
        here = token.between(low, high - 1)
        head = head.when(here, F.lit(shortlist + k - 2))
        band = band.when(here, F.lit(k))
        tail = F.when(here, token - low) if tail is None else tail.when(here, token - low)
    tail = F.lit(None).cast("int") if tail is None else tail
    return head, band, tail

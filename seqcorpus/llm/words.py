"""Words, word hashes and shingle hashes of whole Arrow text columns, as numpy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased.  Hashes are 64-bit
polynomial hashes over a random value per byte, mixed at the end; equal words have equal hashes
whatever batch or task they come from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from seqcorpus.llm.common import slices, text_buffers

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_POWERS = np.cumprod(np.full(64, BASE, np.uint64), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.full(max(n, 2 * len(_POWERS)), BASE, np.uint64), dtype=np.uint64)
    return _POWERS[:n]


@dataclass
class Words:
    """Words of rows lo..hi-1: hash, byte span in the column's buffer, and first word of each row."""

    lo: int
    hi: int
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # hi - lo + 1 offsets into the words

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.lo, self.hi), np.diff(self.first))


def words_of(data: np.ndarray, off: np.ndarray, lo: int, hi: int) -> Words:
    a = data[off[lo]:off[hi]]
    inside = ~SEPARATOR[a]
    bounds = (off[lo:hi + 1] - off[lo]).astype(np.int64)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][np.diff(bounds) > 0]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    at = np.flatnonzero(inside)  # bytes of words, without gaps
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(lo, hi, np.zeros(0, np.uint64), none, none, np.zeros(hi - lo + 1, np.int64))
    compact = np.searchsorted(at, start)
    length = np.diff(np.append(compact, len(at)))
    place = np.arange(len(at)) - np.repeat(compact, length)
    value = BYTE_VALUE[LOWER[a[at]]] * powers(int(length.max()))[place]
    h = mix(np.add.reduceat(value, compact) + length.astype(np.uint64) * STEP)
    return Words(lo, hi, h, start + off[lo], start + length + off[lo], np.searchsorted(start, bounds))


def column_words(arr: pa.Array):
    """Yield the words of a text column, a bounded slice of rows at a time."""
    data, off = text_buffers(arr)
    for lo, hi in slices(off):
        yield words_of(data, off, lo, hi)


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word shingle and the row of each; a row of fewer words (but some) has its
    whole sequence as its one shingle."""
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < width))
    h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = w.row
    if len(w.hash) >= width:
        ok = rows[:len(rows) - width + 1] == rows[width - 1:]
        h = np.zeros(len(w.hash) - width + 1, np.uint64)
        for k in range(width):
            h = h * STEP + w.hash[k:len(h) + k]
        h, row = mix(h)[ok], rows[:len(ok)][ok]
    if len(short):
        # another start value for each word count: a short sequence equals no shingle of five
        own = []
        for r in short:
            acc = np.uint64(n[r])
            with np.errstate(over="ignore"):
                for x in w.hash[w.first[r]:w.first[r + 1]]:
                    acc = acc * BASE + x
            own.append(acc)
        h = np.concatenate([h, mix(np.array(own, np.uint64))])
        row = np.concatenate([row, short + w.lo])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def row_sets(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), by row and then by hash."""
    if not len(h):
        return h, row
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]

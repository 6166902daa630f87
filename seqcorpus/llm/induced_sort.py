"""Suffix sorting of one shard by induced sorting over disk-backed bucket queues.

Suffixes are L (larger than the next) or S (smaller); the leftmost S of each stretch (LMS) seed the sort.
An induction pass is a priority queue in disguise: sorted suffixes are popped in batches, and each induces
the suffix one place to its left, whose priority is (its first symbol, order of arrival).  The queue is cut
into ranges of symbols; what waits in a range is an array on the heap or, above ``memory_items``, in a file
of the task's own scratch folder, and only the range being popped is in memory.  A batch ends before the
first item that something just induced should precede, so batches are long and numpy does the work.

LMS substrings are sorted by one induction with seeds in any order and named; the string of names is sorted
by recursion while it is short of symbols (induction again), else by doubling ranks: in the long alphabets
of names a batch is cut so often that induction took 4.5 times as long.  One more induction from the sorted
seeds gives the suffix array.  With ``depth``, suffixes are only sorted by that many first symbols.
"""

from __future__ import annotations

import os
import shutil

import numpy as np

from seqcorpus.llm.common import local_dir

MEMORY_ITEMS = 1 << 23
#: Positions and symbols; a shard is cut far below this by its caller.
POSITION = np.int32
#: Symbol ranges of a queue: one a byte value, fewer for the long alphabets of names.
RANGES, NAME_RANGES = 512, 128
#: Strings of names with at most this many different names are sorted by induction.
FEW_NAMES = 512


class BucketQueue:
    """FIFO queues of suffix positions by symbol range; long ones wait on disk."""

    def __init__(self, ranges: int, memory_items: int):
        self.heap: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.spilled: set[int] = set()
        self.items, self.most, self.folder = 0, memory_items, None

    def _path(self, k: int) -> str:
        return os.path.join(self.folder, str(k))

    def push(self, k: int, items: np.ndarray) -> None:
        self.heap[k].append(items)
        self.items += len(items)
        if self.items > self.most:
            self.folder = self.folder or local_dir()
            for j, parts in enumerate(self.heap):
                if parts:
                    with open(self._path(j), "ab") as f:
                        for part in parts:
                            part.tofile(f)
                    self.spilled.add(j)
                    parts.clear()
            self.items = 0

    def pop(self, k: int) -> np.ndarray:
        parts = self.heap[k]
        if k in self.spilled:
            parts = [np.fromfile(self._path(k), POSITION), *parts]
            os.truncate(self._path(k), 0)
            self.spilled.discard(k)
        self.items -= sum(map(len, self.heap[k]))
        self.heap[k] = []
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, POSITION), *parts])

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes.  ``t`` ends with a symbol smaller than all others."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    differs = np.flatnonzero(t[:-1] != t[1:])  # the type of a run of equal symbols is that of its last one
    rises = t[differs] < t[differs + 1]
    s[:-1] = np.repeat(rises, np.diff(np.append(-1, differs)))
    return s


def _pass(rank: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, ranges: int, shift: int, memory_items: int) -> np.ndarray:
    """One induction from ``seeds`` (sorted by rank of symbol): all positions i with ``wanted[i]``, sorted.

    An induced item comes before the seeds of its symbol."""
    queue = BucketQueue(ranges, memory_items)
    cut = np.searchsorted(rank[seeds] >> shift, np.arange(ranges + 1))
    out = []
    try:
        for k in range(ranges):
            waiting, own = queue.pop(k), seeds[cut[k]:cut[k + 1]]
            if not len(waiting) and not len(own):
                continue
            # sort key: symbol, induced before seed; order of arrival by stability
            items = np.concatenate([waiting, own])
            key = rank[items] * 2
            key[len(waiting):] += 1
            if shift:
                order = np.argsort(key, kind="stable")
                items, key = items[order], key[order]
            while len(items):
                left = items - 1
                good = wanted[left] & (left >= 0)
                new = rank[left] * 2
                inside = np.flatnonzero(good & (new >> (shift + 1) == k))
                end = len(items)
                if len(inside):
                    # an induced item goes behind the induced items of its symbol that wait already
                    place = np.searchsorted(key, new[inside], "right")
                    reach = np.minimum.accumulate(place)
                    # the first item at or behind the place of something induced before it
                    late = np.maximum(reach, inside + 1)
                    after = np.append(inside[1:], len(items) - 1)
                    hit = np.flatnonzero(late <= after)
                    end = min(end, int(late[hit[0]])) if len(hit) else end
                    inside = inside[inside < end]
                out.append(items[:end][key[:end] & 1 == 0])
                away = good[:end].copy()
                away[inside] = False
                away = np.flatnonzero(away)
                if len(away):
                    to, moved = (new[away] >> (shift + 1)).astype(np.uint16), left[away]
                    order = np.argsort(to, kind="stable")
                    to, moved = to[order], moved[order]
                    first = np.append(0, np.flatnonzero(to[1:] != to[:-1]) + 1)
                    for j, lo, hi in zip(to[first].tolist(), first.tolist(), [*first[1:].tolist(), len(to)], strict=True):
                        queue.push(j, moved[lo:hi])
                more, mkey = left[inside], new[inside]
                items, key = items[end:], key[end:]
                if len(more):
                    items, key = np.concatenate([items, more]), np.concatenate([key, mkey])
                    order = np.argsort(key, kind="stable")
                    items, key = items[order], key[order]
    finally:
        queue.close()
    return np.concatenate([np.zeros(0, POSITION), *out])


def _induce(t: np.ndarray, s: np.ndarray, seeds: np.ndarray, memory_items: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted L suffixes and sorted S suffixes, from LMS positions in the order of their symbols."""
    top = int(t.max())
    shift = 0 if top < RANGES else top.bit_length() - NAME_RANGES.bit_length() + 1
    ranges = (top >> shift) + 1
    larger = _pass(t, ~s, seeds, ranges, shift, memory_items)
    flip = top - t
    ranges_down = (int(flip.max()) >> shift) + 1
    smaller = _pass(flip, s, larger[::-1], ranges_down, shift, memory_items)[::-1]
    return larger, smaller


def _names(t: np.ndarray, sorted_lms: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of LMS substrings in text order, and how many there are."""
    mult = np.uint64(0x9E3779B97F4A7C15)
    lms = lms.astype(np.int64)
    end = np.append(lms[1:], len(t) - 1)
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    power = np.cumprod(np.append(np.uint64(1), np.full(int((end - lms).max()) + 1, mult)), dtype=np.uint64)
    # hash of t[lms .. next lms], ends included
    value = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    start = np.repeat(lms, end - lms + 1)
    step = np.arange(len(start)) - np.repeat(np.cumsum(end - lms + 1) - (end - lms + 1), end - lms + 1)
    h = np.add.reduceat(value[start + step] * power[step], np.cumsum(end - lms + 1) - (end - lms + 1))
    k = place[sorted_lms]
    new = np.append(True, (h[k][1:] != h[k][:-1]) | ((end - lms)[k][1:] != (end - lms)[k][:-1]))
    name = np.empty(len(lms), np.int64)
    name[k] = np.cumsum(new) - 1
    return name, int(new.sum())


def _doubled(name: np.ndarray, depth: int | None) -> np.ndarray:
    """Suffixes of a string of names in order, by ranks of ever longer prefixes (up to ``depth`` names)."""
    n, rank, width = len(name), name.astype(np.int64), 1
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.append(0, np.cumsum(rank[order][1:] != rank[order][:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or depth is not None and width >= depth:
            return order
        second = np.zeros(n, np.int64)
        second[:n - width] = rank[width:] + 1
        rank, width = rank * (n + 1) + second, 2 * width


def suffix_array(t: np.ndarray, memory_items: int = MEMORY_ITEMS, depth: int | None = None) -> np.ndarray:
    """Suffix array of an integer array whose last symbol is smaller than all others."""
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    t = t.astype(POSITION)
    s = types(t)
    lms = (np.flatnonzero(s[1:] & ~s[:-1]) + 1).astype(POSITION)
    if len(lms) > 1:
        _, smaller = _induce(t, s, lms[np.argsort(t[lms], kind="stable")], memory_items)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        found = np.append(lms[-1:], smaller[is_lms[smaller]])  # nothing induces the end symbol
        name, n = _names(t, found, lms)
        names = None if depth is None else depth // 2 + 2  # a name takes two symbols at least
        if n == len(lms):
            lms_sorted = found
        elif n <= FEW_NAMES:
            lms_sorted = lms[suffix_array(name, memory_items, names)]
        else:
            lms_sorted = lms[_doubled(name, names)]
    else:
        lms_sorted = lms
    larger, smaller = _induce(t, s, lms_sorted, memory_items)
    return _merge(t, larger, smaller)


def _merge(t: np.ndarray, larger: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """By first symbol, L before S; what is in neither is the end symbol."""
    size = int(t.max()) + 1
    out = np.empty(len(t), POSITION)
    nl, ns = np.bincount(t[larger], minlength=size), np.bincount(t[smaller], minlength=size)
    rest = np.bincount(t, minlength=size) - nl - ns  # the end symbol
    start = np.cumsum(nl + ns + rest) - (nl + ns + rest)
    out[np.arange(len(larger)) + np.repeat(start - (np.cumsum(nl) - nl), nl)] = larger
    out[np.arange(len(smaller)) + np.repeat(start + nl - (np.cumsum(ns) - ns), ns)] = smaller
    if rest.any():
        out[0] = len(t) - 1
    return out

"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is of type S if it is smaller than the next one, else L; an S after an L is a leftmost S (LMS). All LMS
substrings are sorted and named, the string of their names is sorted by recursion, and from the order of the LMS suffixes
that of the L suffixes is induced, then that of the S suffixes from it. Instead of scanning buckets one suffix at a time, a
whole bucket range is induced at once: an L suffix is ordered by its symbols up to the LMS that follows, an S suffix by its
symbols up to the L that follows, and both ends are known and different. Positions in buckets come from counts; chains of
equal symbols are followed by doubling, so a run of a million equal bytes takes twenty steps.
"""

from __future__ import annotations

import numpy as np


def _chained(rank: np.ndarray, of: np.ndarray, end: np.ndarray) -> None:
    """Refines rank, in place, for the positions `of`: each by the ranks of the positions from it to its end.

    rank holds, for each position, the number of positions that are certainly before it. Ends are ordered already; two
    positions with equal ranks up to their ends keep equal ranks."""
    step = 1
    while len(of):
        key = (rank[of].astype(np.int64) << 32) | rank[of + step]
        order = np.argsort(key)
        of, end, key = of[order], end[order], key[order]
        was = key >> 32
        at = np.arange(len(of))
        group = np.concatenate(([True], was[1:] != was[:-1]))
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[of] = (was + start - np.maximum.accumulate(np.where(group, at, 0))).astype(rank.dtype)
        single = fresh & np.concatenate((fresh[1:], [True]))
        step *= 2
        go = ~single & (of + step <= end)
        of, end = of[go], end[go]


def _kinds(t: np.ndarray) -> np.ndarray:
    """True where the suffix is of type S. The last symbol is the least and occurs once."""
    n = len(t)
    differs = np.flatnonzero(np.concatenate((t[:-1] != t[1:], [True])))
    last = differs[np.searchsorted(differs, np.arange(n))]  # the end of the run of equal symbols
    after = np.minimum(last + 1, n - 1)
    kind = t[last] < t[after]
    kind[n - 1] = True
    return kind


def _induced(t: np.ndarray, kind: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes from the ranks `order` of the LMS suffixes; with equal ranks, those of the substrings up to the next LMS."""
    n, size = len(t), int(t.max()) + 1
    rank = np.zeros(n + 1, np.int64)
    low = np.flatnonzero(~kind)
    larges, leasts = np.bincount(t[low], minlength=size), np.bincount(t[lms], minlength=size)
    both = np.cumsum(larges + leasts) - larges - leasts
    rank[low] = both[t[low]]
    first = np.cumsum(leasts) - leasts  # LMS of smaller symbols
    rank[lms] = (both + larges)[t[lms]] + (order - first[t[lms]] if order.any() else 0)
    _chained(rank, low, lms[np.searchsorted(lms, low)])
    place = rank[low] - both[t[low]]  # within the L part of the bucket
    high = np.flatnonzero(kind[:-1])
    smalls = np.bincount(t[high], minlength=size)
    smalls[t[n - 1]] += 1
    begins = np.cumsum(larges + smalls) - larges - smalls
    rank[low] = begins[t[low]] + place
    rank[high] = (begins + larges)[t[high]]
    rank[n - 1] = 0
    ends = np.concatenate((low, [n - 1])) if not len(low) or low[-1] < n - 1 else low
    _chained(rank, high, ends[np.searchsorted(ends, high)])
    return rank[:n]


def ranks(t: np.ndarray) -> np.ndarray:
    """The rank of every suffix of t, whose last symbol is the least and occurs nowhere else."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    kind = _kinds(t)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    found = _induced(t, kind, lms, np.zeros(len(lms), np.int64))[lms]
    names, reduced = np.unique(found, return_inverse=True)
    order = reduced if len(names) == len(lms) else ranks(reduced.astype(np.int64))
    return _induced(t, kind, lms, order)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t in order (see ranks)."""
    rank = ranks(t)
    out = np.empty(len(t), np.int64)
    out[rank] = np.arange(len(t))
    return out


def permuted_prefixes(t: np.ndarray, array: np.ndarray, end: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the suffix before it in order (-1 for the first), and how many symbols both share, up to its own end.

    Where both are preceded by the same symbol, the position before tells it (one more than here); all others, and the
    positions in `fresh`, are compared, eight symbols at a time. t: symbols below 2^16."""
    n = len(t)
    before = np.full(n, -1)
    before[array[1:]] = array[:-1]
    same = np.zeros(n, bool)
    same[1:] = (before[1:] > 0) & (t[:-1] == t[np.maximum(before[1:] - 1, 0)])
    same[fresh] = False
    own = np.flatnonzero(~same & (before >= 0))
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.zeros(8, t.dtype)])
    live, other, at = own, before[own], 0
    while len(live):
        differs = np.zeros((len(live), 8), bool)
        for j in range(8):
            differs[:, j] = padded[np.minimum(live + at + j, n)] != padded[np.minimum(other + at + j, n)]
        stop = differs.argmax(1)
        some = differs.any(1)
        shared[live] = at + np.where(some, stop, 8)
        at += 8
        go = ~some & (live + at < end[live])
        live, other = live[go], other[go]
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    shared = shared[start] - (np.arange(n) - start)
    return before, np.minimum(np.maximum(shared, 0), end - np.arange(n))

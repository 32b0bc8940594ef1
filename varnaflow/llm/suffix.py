"""Suffix arrays by induced sorting, and permuted common prefixes, with NumPy.

Induced sorting is sequential by nature, but within one bucket (one first symbol)
all suffixes whose order is known can induce their left neighbours together: a
round takes the known part of a bucket, moves its predecessors to the ends of
their buckets in order, and goes on with those that fell into the same bucket.
So each scan takes a few array operations for each symbol instead of one step for
each suffix, and the work stays linear.  Reduced strings, whose symbols are names
of substrings, may have nearly as many symbols as places; there suffixes are
induced one by one, in the same order.
"""

from __future__ import annotations

import numpy as np

#: With fewer places for each symbol than this, a bucket is too small for array operations and suffixes are induced one by one.
PLACES = 100


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last, a unique least symbol, is)."""
    n = len(t)
    step = np.sign(np.diff(t))
    place = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    out = np.ones(n, bool)
    some = nearest < n
    out[:-1][some] = step[nearest[some]] > 0
    return out


def _push(t: np.ndarray, sa: np.ndarray, edge: np.ndarray, order: np.ndarray, sign: int) -> None:
    """Put suffixes, in this order, at the moving edges of their buckets."""
    symbols = t[order]
    by = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[by]
    first = np.flatnonzero(np.diff(sorted_symbols, prepend=-1))
    counts = np.diff(np.append(first, len(by)))
    rank = np.arange(len(by)) - np.repeat(first, counts)
    sa[edge[sorted_symbols] + sign * rank] = order[by]
    edge[sorted_symbols[first]] += sign * counts


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that sorted leftmost-smaller suffixes induce."""
    n = len(t)
    counts = np.bincount(t)
    if np.count_nonzero(counts) * PLACES > n:
        return _induce_each(t, small, lms)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    tail = ends - 1
    _push(t, sa, tail, lms[::-1], -1)
    first_lms = tail + 1  # of each bucket
    head = starts.copy()
    symbols = np.flatnonzero(counts)
    for c in symbols.tolist():  # larger suffixes, left to right
        at = starts[c]
        while at < head[c]:
            known = sa[at : head[c]]
            at = head[c]
            before = known[known > 0] - 1
            before = before[~small[before]]
            if len(before):
                _push(t, sa, head, before, 1)
        known = sa[first_lms[c] : ends[c]]
        before = known[known > 0] - 1  # larger, by what leftmost-smaller means
        if len(before):
            _push(t, sa, head, before, 1)
    tail = ends - 1
    for c in symbols[::-1].tolist():  # smaller suffixes, right to left
        at = ends[c] - 1
        while at > tail[c]:
            known = sa[tail[c] + 1 : at + 1][::-1]
            at = tail[c]
            before = known[known > 0] - 1
            before = before[small[before]]
            if len(before):
                _push(t, sa, tail, before, -1)
        known = sa[starts[c] : head[c]][::-1]
        before = known[known > 0] - 1
        before = before[small[before]]
        if len(before):
            _push(t, sa, tail, before, -1)
    if sa[0] < 0:
        sa[0] = n - 1
    return sa


def _induce_each(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """``_induce`` for strings of many symbols, one suffix at a time."""
    n = len(t)
    counts = np.bincount(t)
    ends = np.cumsum(counts)
    # symbol of the suffix to the left if it is larger, or smaller, than this one; the last entry stands for an empty place
    larger, smaller = np.full((2, n + 1), -1, np.int64)
    larger[1:n] = np.where(small[:-1], -1, t[:-1])
    smaller[1:n] = np.where(small[:-1], t[:-1], -1)
    start = np.full(n, n, np.int64)
    _push(t, start, ends - 1, lms[::-1], -1)
    sa, left, head = start.tolist(), larger.tolist(), (ends - counts).tolist()
    for i in sa:  # left to right; the list grows ahead of its reader
        c = left[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    left, tail = smaller.tolist(), (ends - 1).tolist()
    for i in reversed(sa):  # right to left; leftmost smaller suffixes are overwritten
        c = left[i]
        if c >= 0:
            at = tail[c]
            sa[at] = i - 1
            tail[c] = at - 1
    sa[0] = n - 1  # the last symbol is the least and comes once
    return np.array(sa, np.int64)


def _same_pieces(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether t[a:a+length] equals t[b:b+length], for arrays of places."""
    out = np.ones(len(a), bool)
    live, k = np.flatnonzero(length > 0), 0
    while len(live):
        good = t[a[live] + k] == t[b[live] + k]
        out[live[~good]] = False
        k += 1
        live = live[good & (length[live] > k)]
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of ``t``; its last symbol is the least and comes once."""
    n = len(t)
    if n <= 2:
        return np.argsort(t, kind="stable") if n < 2 or t[0] != t[1] else np.arange(n)[::-1]
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) <= 1:
        return _induce(t, small, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = _induce(t, small, lms)
    order = order[is_lms[order]]
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    where = np.flatnonzero(same)
    same[where] = _same_pieces(t, a[where], b[where], length[a[where]])
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    n_names = int(reduced.max()) + 1
    if n_names == len(lms):
        return _induce(t, small, order)
    return _induce(t, small, lms[suffix_array(reduced)])


def _common(t: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The common prefix of t[p:] and t[q:] within ``most``, for arrays of places: several symbols in a word at once."""
    size = 2 if t.max(initial=0) < 1 << 16 else 4
    step, round_ = 8 // size, 0
    padded = np.concatenate([t, np.zeros(step, t.dtype)]).astype(f"<u{size}")
    words = np.ndarray(len(t) + 1, "<u8", padded, strides=(size,))  # one from each place on
    value, live, k = np.zeros(len(p), np.int64), np.flatnonzero(most > 0), 0
    while len(live):
        grid = k + step * np.arange(min(64, 4 ** min(3, round_ // 2)))
        a, b = p[live][:, None] + grid, q[live][:, None] + grid
        x = words[np.minimum(a, len(t))] ^ words[np.minimum(b, len(t))]
        differ = x != 0
        hit = differ.any(axis=1)
        at = differ[hit].argmax(axis=1)
        first = x[hit][np.arange(len(at)), at]
        value[live[hit]] = grid[at] + np.bitwise_count((first & -first) - np.uint64(1)).astype(np.int64) // (8 * size)
        k = int(grid[-1]) + step
        value[live[~hit]] = k
        live = live[~hit & (most[live] > k)]
        round_ += 1
    return np.minimum(value, most)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each place, the common prefix with the suffix before it in ``sa``, within ``stop``.

    ``stop[i]`` bounds how far a suffix may be compared (the end of its string).
    A value is at least the one to the left less one, and exactly that unless the
    symbols to the left differ; so only those places are compared, and the rest
    follow from the nearest one to the left.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    own = np.ones(n, bool)
    i = np.arange(1, n)
    left = before[1:]
    own[1:] = (left <= 0) | (t[i - 1] != t[left - 1]) | (stop[i - 1] != stop[i]) | (stop[left - 1] != stop[left])
    places = np.flatnonzero(own)
    other = before[places]
    some = np.flatnonzero(other >= 0)
    p, q = places[some], other[some]
    value = _common(t, p, q, np.minimum(stop[p] - p, stop[q] - q))
    out = np.zeros(len(places), np.int64)
    out[some] = value
    nearest = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    full = np.zeros(n, np.int64)
    full[places] = out
    return np.maximum(full[nearest] - (np.arange(n) - nearest), 0)

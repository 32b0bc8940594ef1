"""Hashes of words and of runs of words for whole batches at once, with NumPy.

The hashes only place rows and find candidates; exact comparisons follow wherever
they are used.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _INVERSE):
        x = np.full(n, np.uint64(b), np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, ``n`` at least."""
    return _powers(1 << max(16, (n - 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads entropy over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word between ASCII white space."""
    black = np.zeros(len(data) + 2, np.int8)
    black[1:-1] = ~_WHITE[np.frombuffer(data, np.uint8)]
    edge = np.diff(black)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Bytes whose words are hashed together; only a longer word takes more.
_TOGETHER = 1 << 18


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``starts`` ascend."""
    out = np.zeros(len(starts), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + 1, _TOGETHER)).tolist()
    for a, z in zip(cuts, [*cuts[1:], len(starts)], strict=True):
        if a < z:
            first = int(starts[a])
            part, s, e = raw[first : int(ends[a:z].max())], starts[a:z] - first, ends[a:z] - first
            up, down = powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            out[a:z] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return out


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive hashes; one for each start."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each ``n`` consecutive values."""
    if len(x) < n:
        return x[:0]
    out, width = x, 1
    while 2 * width <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])

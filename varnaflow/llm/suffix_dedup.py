"""Exact substring dedup over bytes, by suffix arrays of shards.

Every ``window``-byte string travels inside a super-k-mer to its minimiser's
bucket (see ``superkmer``), so all places of a repeated string meet in one shard.
A shard's packed strings are joined, their suffixes sorted by induced sorting, and
the permuted common prefixes computed; a window repeats exactly if its suffix has
a common prefix of ``window`` bytes with a neighbour.  A string that comes twice
as a whole repeats as a whole and needs no sorting, so groups of copies cost one
string, and strings whose minimiser comes once are never sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_by_bytes, texts, utf8
from .suffix import permuted_lcp, suffix_array
from .superkmer import Answer, Kind, Strings, covered, groups, refined, united, with_spans

WINDOW = 200
#: Bytes in a minimiser.
K = 32
#: Bytes sorted at once; a larger group of one minimiser is cut again by longer minimisers.
SHARD_BYTES = 512 << 10
#: Smaller than every doc_id: the window repeats for all.
ALWAYS = -(1 << 63)
KEPT = "doc_id long, n_bytes long, n_removed long, kept binary, spans array<struct<start:long,end:long>>"


def repeats_in(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string, whether each of its windows comes again in any of them."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    t = np.frombuffer(b"\0".join(strings) + b"\0\0", np.uint8).astype(np.int64) + 2
    t[ends] = 1
    t[-1] = 0
    stop = np.append(np.repeat(ends, sizes + 1), len(t) - 1)
    sa = suffix_array(t)
    common = permuted_lcp(t, sa, stop)
    flags = np.zeros(len(t), bool)
    second = np.flatnonzero(common[sa] >= window)
    flags[sa[second]] = True
    flags[sa[second - 1]] = True
    return [flags[e - n : e - window + 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


class _Shards:
    """Sorts groups in shards and notes the repeated windows of their strings."""

    def __init__(self, kind: Kind) -> None:
        self.kind, self.held = kind, 0
        self.flags: dict[int, np.ndarray] = {}
        self.shard: list[tuple[bytes, int, int]] = []

    def note(self, owner: int, first: int, flags: np.ndarray) -> None:
        mine = self.flags[owner]
        mine[first : first + len(flags)] |= flags

    def group(self, entries: list[tuple[bytes, int, int]], k: int) -> None:
        """entries: (string, owner, first window); a negative owner is a witness only."""
        size = sum(len(e[0]) for e in entries)
        if size > SHARD_BYTES and k < self.kind.window:
            k = min(self.kind.window, k + 56)
            for finer in refined(self.kind, k, [e[0] for e in entries]):
                places: dict[bytes, list[tuple[int, int]]] = {}
                for s, i, first, _, _ in finer:
                    places.setdefault(s, []).append((entries[i][1], entries[i][2] + first))
                for s, where in places.items():
                    if len(where) > 1:
                        for owner, first in where:
                            if owner >= 0:
                                self.note(owner, first, np.ones(len(s) - self.kind.window + 1, bool))
                if len(places) > 1 or len(finer) == 1 and finer[0][4]:
                    self.group([(s, where[0][0] if len(where) == 1 else -1, where[0][1]) for s, where in places.items()], k)
            return
        if self.held and self.held + size > SHARD_BYTES:
            self.solve()
        self.shard += entries
        self.held += size

    def solve(self) -> None:
        if self.shard:
            for (_, owner, first), flags in zip(self.shard, repeats_in([e[0] for e in self.shard], self.kind.window), strict=True):
                if owner >= 0:
                    self.note(owner, first, flags)
        self.shard, self.held = [], 0


def repeated_windows(strings: Strings, kind: Kind) -> Answer:
    """For each string, runs of windows that start elsewhere too."""
    out: Answer = [[]] * len(strings.data)
    shards = _Shards(kind)
    owned: dict[int, list[int]] = {}
    for group in groups(strings.mins):
        different: dict[bytes, list[int]] = {}
        for i in group.tolist():
            different.setdefault(strings.data[i], []).append(i)
        whole = {s for s, members in different.items() if sum(int(strings.count[i]) for i in members) > 1}
        for s in whole:
            for i in different[s]:
                out[i] = [(0, int(strings.n[i]), ALWAYS)]
        if len(different) > 1 or not whole and strings.periodic[group[0]]:
            entries = []
            for s, members in different.items():
                entries.append((s, -1 if s in whole else members[0], 0))
                if s not in whole:
                    owned[members[0]] = members
                    shards.flags[members[0]] = np.zeros(int(strings.n[members[0]]), bool)
            shards.group(entries, kind.k)
    shards.solve()
    for owner, members in owned.items():
        edge = np.flatnonzero(np.diff(shards.flags[owner], prepend=False, append=False)).tolist()
        runs = [(a, b, ALWAYS) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        for i in members:
            out[i] = runs
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, kept bytes, maximal removed byte ranges.

    A null text is empty.  Rows with a null or repeated doc_id are documents of
    their own, so equal rows repeat each other.  An empty table gives no rows.
    """
    source = texts(docs)
    spans = covered(source, Kind(False, window, k), repeated_windows, **sizes)
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "text"):
                out = []
                for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                    ranges = united(found)
                    kept, at = [], 0
                    for s, e in ranges:
                        kept.append(text[at:s])
                        at = e
                    left = b"".join([*kept, text[at:]])
                    out.append((doc_id, len(text), len(text) - len(left), left, [{"start": s, "end": e} for s, e in ranges]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kind, strict=True)], schema=kind)

    return with_spans(source, spans).mapInArrow(apply, KEPT)

"""Substring dedup over words: windows that an earlier document has are removed.

Windows are exchanged as super-k-mers (see ``superkmer``).  In a bucket, the
windows of each minimiser are sorted by their words, so equal ones stand together
and the smallest document of each run is exact.  A word is removed if a window
that covers it also starts in a document with a smaller doc_id; windows are judged
on the input, never on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_by_bytes, texts, utf8
from .superkmer import Answer, Kind, Strings, covered, groups, refined, united, with_spans

WINDOW = 13
#: Words in a minimiser.
K = 3
KEPT = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


#: Strings of one minimiser whose windows are sorted at once; more are cut again by longer minimisers.
AT_ONCE = 2000


def _windows(s: bytes, n: int, window: int) -> list[bytes]:
    stops = np.flatnonzero(np.frombuffer(s, np.uint8) == 32).tolist()
    begins, ends = [0, *(x + 1 for x in stops)], [*stops, len(s)]
    return [s[begins[j] : ends[j + window - 1]] for j in range(n)]


def _sorted_least(entries: list[tuple[bytes, int, int, int]], smallest: list[int], least_of: list[list[int]], window: int) -> None:
    """entries: (string, owner, first window, windows).  Sorts all windows; equal ones get the smallest document of any."""
    rows = [(w, smallest[owner], owner, first + j) for s, owner, first, n in entries for j, w in enumerate(_windows(s, n, window))]
    rows.sort()
    run, least = None, 0
    for w, doc, owner, j in rows:
        if w != run:
            run, least = w, doc  # sorted: the first of equal windows has the smallest document
        least_of[owner][j] = least


def smallest_documents(strings: Strings, kind: Kind) -> Answer:
    """For each string, runs of windows with the smallest document that has them."""
    out: Answer = [[]] * len(strings.data)
    for group in groups(strings.mins):
        members = group.tolist()
        different: dict[bytes, list[int]] = {}
        for i in members:
            different.setdefault(strings.data[i], []).append(i)
        least = [min(int(strings.smallest[i]) for i in same) for same in different.values()]
        n = [int(strings.n[same[0]]) for same in different.values()]
        if len(different) == 1:
            for i in members:
                out[i] = [(0, n[0], least[0])]
            continue
        least_of = [[doc] * windows for doc, windows in zip(least, n, strict=True)]
        data = list(different)
        todo: list[tuple[int, list[tuple[bytes, int, int, int]]]] = [(kind.k, [(s, owner, 0, n[owner]) for owner, s in enumerate(data)])]
        while todo:
            k, entries = todo.pop()
            if len(entries) <= AT_ONCE or k == kind.window:
                _sorted_least(entries, least, least_of, kind.window)
            else:
                k = min(kind.window, k + 3)
                for finer in refined(kind, k, [e[0] for e in entries]):
                    todo.append((k, [(s, entries[i][1], entries[i][2] + first, windows) for s, i, first, windows, _ in finer]))
        for values, same in zip(least_of, different.values(), strict=True):
            runs, at = [], 0
            for j in range(1, len(values) + 1):
                if j == len(values) or values[j] != values[at]:
                    runs.append((at, j, values[at]))
                    at = j
            for i in same:
                out[i] = runs
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept text, removed word ranges.

    A null text has no words.  A null doc_id counts as larger than every other;
    rows that repeat a doc_id are documents of their own, and none is smaller than
    another, so their common windows stay.  An empty table gives no rows.
    """
    source = texts(docs)
    spans = covered(source, Kind(True, window, k), smallest_documents, **sizes)
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "text"):
                out = []
                for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                    words, ranges = text.split(), united(found)
                    kept, at = [], 0
                    for s, e in ranges:
                        kept += words[at:s]
                        at = e
                    kept += words[at:]
                    out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), [{"start": s, "end": e} for s, e in ranges]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kind, strict=True)], schema=kind)

    return with_spans(source, spans).mapInArrow(apply, KEPT)

"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are ``window`` consecutive words (a shorter item is one window).
A window is the set of its 3-word shingles, and a document contains it only if it
contains all of them; so one shingle is a sufficient prefix.  Shingles are ordered
by rarity, counted over all documents, and each window is joined on its rarest.
A position that has the shingle gives one possible start; length and positional
bounds drop starts outside the document, and the words there are compared exactly.

The item side is collected only up to ``block_bytes`` of text; a larger benchmark
is joined block by block, each block against all documents, and the hits united
by document.  Documents are scanned where they lie: no shuffle of texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, row_key, stored, texts, utf8
from .wordhash import run_hashes, word_hashes, word_spans

WINDOW = 10
SHINGLE = 3
#: Item text that one block may hold (broadcast to every worker).
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z; every other ASCII character than a-z and 0-9 parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HITS = "doc_id long, row long, n_words long, items array<string>, spans array<struct<start:long,end:long>>"


class Index:
    """The windows of a block of items, as arrays over the items' words in a row."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        split = [(item, words) for item, text in items if (words := text.translate(_TABLE).split())]
        self.items = [item for item, _ in split]
        self.data = b" ".join(w for _, words in split for w in words)
        self.starts, self.ends = word_spans(self.data)
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        sizes = np.array([len(words) for _, words in split], np.int64)
        first = np.cumsum(sizes) - sizes
        n = np.maximum(sizes - window + 1, 1)
        self.owner = np.repeat(np.arange(len(split)), n)
        self.begin = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.length = np.repeat(np.minimum(sizes, window), n)
        #: width -> sorted shingle hashes; a window under SHINGLE words is one shingle of its own width
        self.known = {k: np.unique(run_hashes(self.hashes, k)) for k in np.unique(np.minimum(self.length, SHINGLE)).tolist()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def order(self, counts: dict[int, dict[int, int]]) -> None:
        """Choose each window's rarest shingle; of equally rare ones, the first."""
        for k in self.known:
            h = run_hashes(self.hashes, k)
            rarity = np.array([counts.get(k, {}).get(x, 0) for x in h.tolist()], np.int64)
            mine = np.flatnonzero(np.minimum(self.length, SHINGLE) == k)
            offset = np.zeros(len(mine), np.int64)
            for n in np.unique(self.length[mine]).tolist():
                same = np.flatnonzero(self.length[mine] == n)
                places = self.begin[mine[same]][:, None] + np.arange(n - k + 1)
                offset[same] = np.argmin(rarity[places], axis=1)
            key = h[self.begin[mine] + offset]
            by = np.argsort(key, kind="stable")
            keys, start = np.unique(key[by], return_index=True)
            self.prefix[k] = keys, np.append(start, len(by)), mine[by], offset[by]


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of known keys, and which key."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == h)
    return hit, at[hit]


def _count(rows: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    sums = {k: np.zeros(len(v), np.int64) for k, v in index.known.items()}
    for whole in rows:
        for batch in batches_by_bytes(whole, "text", 2 << 20):
            data = b"\n".join(utf8(batch.column("text"))).translate(_TABLE)
            h = word_hashes(data, *word_spans(data))
            for k, keys in index.known.items():
                sums[k] += np.bincount(_found(keys, run_hashes(h, k))[1], minlength=len(keys))
    for k, keys in index.known.items():
        some = np.flatnonzero(sums[k])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(keys[some].view(np.int64)), pa.array(sums[k][some])], ["k", "shingle", "n"])


def _match(batch_texts: list[bytes], index: Index) -> list[tuple[int, list[str], list[tuple[int, int]]]]:
    """For each text: number of words, items that occur, hit word ranges."""
    clean = [t.translate(_TABLE) for t in batch_texts]
    data = b"\n".join(clean)
    starts, ends = word_spans(data)
    h = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in clean)]))
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for k, (keys, first, windows, offsets) in index.prefix.items():
        at, key = _found(keys, run_hashes(h, k))
        n = first[key + 1] - first[key]
        entry = np.repeat(first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, w = np.repeat(at, n), windows[entry]
        begin, length = p - offsets[entry], index.length[w]
        doc = np.searchsorted(bounds, p, "right") - 1
        good = np.flatnonzero((begin >= bounds[doc]) & (begin + length <= bounds[doc + 1]))  # position and length
        for j in range(index.window):
            place = np.minimum(begin[good] + j, len(h) - 1)
            other = np.minimum(index.begin[w[good]] + j, len(index.hashes) - 1)
            good = good[(j >= length[good]) | (h[place] == index.hashes[other])]
        for d, b, e, x in zip(doc[good].tolist(), begin[good].tolist(), (begin + length)[good].tolist(), w[good].tolist(), strict=True):
            theirs = index.data[index.starts[index.begin[x]] : index.ends[index.begin[x] + e - b - 1]]
            if b" ".join(data[starts[b] : ends[e - 1]].split()) == theirs:
                hits[d].append((b - int(bounds[d]), e - int(bounds[d])))
                items[d].add(index.items[index.owner[x]])
    return [(int(bounds[d + 1] - bounds[d]), sorted(items[d]) if d in items else [], _union(hits[d]) if d in hits else []) for d in range(len(clean))]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_HITS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _scan(rows: Iterator[pa.RecordBatch], index: Index, all_rows: bool) -> Iterator[pa.RecordBatch]:
    for whole in rows:
        for batch in batches_by_bytes(whole, "text", 2 << 20):
            out = [(i, r, n, items, [{"start": s, "end": e} for s, e in spans]) for i, r, (n, items, spans) in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), _match(utf8(batch.column("text")), index), strict=True) if all_rows or spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, _HITS, strict=True)], schema=_HITS)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, row, n_words, items (ids as strings, sorted) and hit word ranges.

    Null and empty texts have no words; items without words or with a null id are
    never found (null ids) or match nothing; rows with a null or repeated doc_id are
    documents of their own (``row`` tells different texts apart); items that repeat
    an id are one item.  Long texts are read whole; of equally rare shingles a window
    joins on its first.  Other columns are not read.  Empty tables give no rows, or
    rows without hits.
    """
    docs = texts(docs).withColumn("row", row_key())
    wanted = texts(items, "item_id").where(F.col("doc_id").isNotNull())
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // block_bytes))
    context, found = docs.sparkSession.sparkContext, []
    for block in range(n_blocks):
        part = wanted if n_blocks == 1 else wanted.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)) == block)
        index = Index([(str(r[0]), r[1].encode("utf-8", "replace")) for r in part.toLocalIterator()], window)
        shared = context.broadcast(index)
        rows = docs.select("text").mapInArrow(lambda rows, shared=shared: _count(rows, shared.value), "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n"))
        counts: dict[int, dict[int, int]] = defaultdict(dict)
        for k, shingle, n in rows.collect():  # one row for each shingle of the block at most
            counts[k][shingle % (1 << 64)] = n
        index.order(counts)
        ready = context.broadcast(index)
        found.append(docs.mapInArrow(lambda rows, shared=ready, first=not block: _scan(rows, shared.value, first), HITS))
    if n_blocks == 1:
        return found[0]
    # block 0 has every row, also those that repeat an id and text, which the hits of all blocks are joined back to
    both = found[0].withColumn("every", F.lit(True))
    for more in (x.withColumn("every", F.lit(False)) for x in found[1:]):
        both = both.unionByName(more)

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def united(spans):  # noqa: ANN001, ANN202
        return spans.map(lambda found: [{"start": s, "end": e} for s, e in _union([(x["start"], x["end"]) for x in found])])

    both = stored(both, "hits")
    merged = both.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    merged = merged.withColumn("spans", united("spans"))
    rows = both.where("every").select("doc_id", "row", "n_words")
    found_in = rows.join(merged, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row") == F.col("hit_row")), "left")
    return found_in.select("doc_id", "row", "n_words", *[F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("items", "spans")])


def report(hits: DataFrame) -> DataFrame:
    """The digest columns of ``decontaminate``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )

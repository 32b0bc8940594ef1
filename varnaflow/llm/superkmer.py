"""Exchange of windows by minimiser, as packed runs.

A window is ``window`` consecutive units (words or bytes).  Its minimiser is the
least hash among the runs of ``k`` units inside it, so equal windows have equal
minimisers.  Consecutive windows that share a minimiser travel as one packed
string to the minimiser's bucket, where all equal windows meet.

A map task works on chunks of its texts.  A string that several documents of a
chunk have travels once for the chunk, so a group of copies, however large, sends
each bucket one string for each chunk.  For each chunk and bucket there are three
rows, and a bucket reads them in this order:

0. the minimisers, 32 bits each; those met once everywhere cannot repeat and are
   forgotten with their strings,
1. the strings, compressed together, with the chunk's facts on each,
2. the occurrences (document, place), answered and dropped one row at a time.

Rows are sorted by Spark within a partition, with spilling; a bucket's memory
holds the strings with repeated minimisers only.  Each bucket is a task of its own
while there are fewer than ``MOST_TASKS``.

A run of units that very many windows have, such as a common phrase, would bring
them all to one bucket.  So common runs, counted over a sample of the documents,
come last in the order of minimisers: a window has one of them only where it has
no other run, and windows of nothing but common runs are mostly equal strings,
which travel once for a chunk.  The sample decides where windows meet, never what
is found.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, release, row_key, utf8
from .wordhash import mix, powers, run_hashes, sliding_min, word_hashes, word_spans

#: Text bytes of a chunk; with very many buckets, chunks grow so that rows keep some ``ROW_BYTES``, up to eight times.
CHUNK_BYTES = 8 << 20
ROW_BYTES = 1 << 10
#: Packed bytes meant for one bucket, and the most tasks that buckets are dealt to.
BUCKET_BYTES = 32 << 20
MOST_TASKS = 1 << 14
#: Text bytes sampled for common runs, at least, or a share of the whole; runs are taken for common from so many times, and so many of them.
SAMPLE_BYTES, SAMPLE_SHARE = 16 << 20, 1024
COMMON_TIMES, COMMON = 64, 1 << 14
#: Bits of a run's hash by which common ones are marked; others that share them are marked too, which does no harm.
MARK_BITS = 20
#: Text bytes that are hashed together.
BLOCK_BYTES = 128 << 10
#: Units in one segment of a very long text; segments overlap by a window less one.
SEGMENT = 1 << 17
#: Windows in one packed string at most.
MAX_RUN = 1024
#: Low bits of a hash that give way to its place among those hashed together, which are fewer.
PLACE_BITS = np.uint64(24)
_LAST_PLACE = np.uint64((1 << 24) - 1)
#: Stands for a null doc_id: no smaller document than any other.
NO_ID = (1 << 63) - 1

SPANS = "doc_id long, row long, start long, end long"


@dataclass(frozen=True)
class Kind:
    """Units of a text: words between ASCII white space, or bytes."""

    words: bool
    window: int
    k: int
    #: Marks of common runs.
    common: np.ndarray | None = field(default=None, compare=False, repr=False)

    def grams(self, data: bytes) -> np.ndarray:
        """A hash of each run of ``k`` units of ``data``."""
        return run_hashes(word_hashes(data, *word_spans(data)), self.k) if self.words else _gram_hashes(data, self.k)

    def ordered(self, g: np.ndarray) -> np.ndarray:
        """Hashes in the order of minimisers: common runs last."""
        return g if self.common is None else g >> np.uint64(1) | self.common[g >> np.uint64(64 - MARK_BITS)].astype(np.uint64) << np.uint64(63)

    def segments(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(first unit, bytes) of each segment that holds a window."""
        units = text.split() if self.words else text
        for at in range(0, max(0, len(units) - self.window + 1), SEGMENT):
            part = units[at : at + SEGMENT + self.window - 1]
            yield at, b" ".join(part) if self.words else part

    def runs(self, parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed strings of several segments at once.

        Returns all bytes, and for each string its first and past-last byte, its
        segment, its first unit there, its number of windows, its minimiser, and
        whether the minimiser comes again in it.
        """
        data = (b"\n" if self.words else b"").join(parts)
        if self.words:
            starts, ends = word_spans(data)
            g = run_hashes(word_hashes(data, starts, ends), self.k)
            bounds = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        else:
            g = _gram_hashes(data, self.k)
            bounds = np.cumsum([0, *map(len, parts)])
        # 40 bits of each hash over its place, so that a minimum tells the first place, or the last
        g, at = self.ordered(g) >> PLACE_BITS << PLACE_BITS, np.arange(len(g), dtype=np.uint64)
        least = sliding_min(g | at, self.window - self.k + 1)
        last_least = sliding_min(g | _LAST_PLACE - at, self.window - self.k + 1)
        valid = np.ones(len(least), bool)
        for b in bounds[1:-1].tolist():
            valid[max(0, b - self.window + 1) : b] = False
        at = np.flatnonzero(valid)
        if not len(at):
            e = np.zeros(0, np.int64)
            return data, e, e, e, e, e, e.astype(np.uint64), e.astype(bool)
        value = least[at] >> PLACE_BITS
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(place % MAX_RUN == 0)
        n = np.diff(np.append(first, len(at)))
        begin, value = at[first], value[first]
        again = least[begin] & _LAST_PLACE != _LAST_PLACE - (last_least[begin + n - 1] & _LAST_PLACE)
        last = begin + n + self.window - 2
        segment = np.searchsorted(bounds, begin, "right") - 1
        low, high = (starts[begin], ends[last]) if self.words else (begin, last + 1)
        return data, low, high, segment, begin - bounds[segment], n, value, again


def _gram_hashes(data: bytes, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive bytes."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(data) - k + 1])


def _pack(zstd: zstandard.ZstdCompressor, *x: object) -> bytes:
    return zstd.compress(pickle.dumps(x, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301  our own rows


class Chunk:
    """Packed strings of a bounded amount of text, each different one once."""

    def __init__(self, kind: Kind, buckets: int, number: int) -> None:
        self.kind, self.buckets, self.number = kind, buckets, number
        self.strings: dict[bytes, int] = {}
        self.docs: list[tuple[int, int, int]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.waits = 0
        self.waiting: list[bytes] = []

    def add(self, doc_id: int, row: int, first: int, part: bytes) -> None:
        self.docs.append((doc_id, row, first))
        self.waiting.append(part)
        self.size += len(part)
        self.waits += len(part)
        if self.waits >= BLOCK_BYTES:
            self._run()

    def _run(self) -> None:
        data, low, high, segment, place, n, value, again = self.kind.runs(self.waiting)
        number = self.strings
        string = np.fromiter((number.setdefault(data[a:b], len(number)) for a, b in zip(low.tolist(), high.tolist(), strict=True)), np.int32, len(low))
        segment = segment + len(self.docs) - len(self.waiting)
        place = place + np.array([d[2] for d in self.docs[len(self.docs) - len(self.waiting) :]], np.int64)[segment - len(self.docs) + len(self.waiting)]
        self.parts.append((string, segment.astype(np.int32), place, n.astype(np.uint16), value, again))
        self.waiting, self.waits = [], 0

    def rows(self) -> Iterator[tuple[int, int, int, bytes]]:
        """bucket, step, chunk, blob."""
        if self.waiting:
            self._run()
        if not self.strings:
            return
        string, segment, place, n, value, periodic = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts = []
        strings = list(self.strings)
        self.strings = {}
        ids = np.array([d[0] for d in self.docs], np.int64)
        rows = np.array([d[1] for d in self.docs], np.int64)
        count = np.bincount(string)
        smallest = np.full(len(strings), NO_ID)
        np.minimum.at(smallest, string, ids[segment])
        own, own_periodic, own_n = np.zeros(len(strings), np.uint64), np.zeros(len(strings), bool), np.zeros(len(strings), np.uint16)
        own[string], own_periodic[string], own_n[string] = value, periodic, n
        bucket = (mix(own) % np.uint64(self.buckets)).astype(np.int32)
        zstd = zstandard.ZstdCompressor(level=6)
        by = np.argsort(bucket, kind="stable")
        by_occurrence = np.argsort(bucket[string], kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        occurrence_edges = np.searchsorted(bucket[string[by_occurrence]], bucket[by[edges]])
        local = np.empty(len(strings), np.uint32)
        for a, z, o, y in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], occurrence_edges.tolist(), [*occurrence_edges[1:].tolist(), len(by_occurrence)], strict=True):
            mine, seen = by[a:z], by_occurrence[o:y]
            b = int(bucket[mine[0]])
            local[mine] = np.arange(len(mine))
            yield b, 0, self.number, _pack(zstd, own[mine].astype(np.uint32), (count[mine] > 1) | own_periodic[mine])
            packed = [strings[j] for j in mine.tolist()]
            yield b, 1, self.number, _pack(zstd, np.array([len(x) for x in packed], np.uint32), own_n[mine], smallest[mine], count[mine].astype(np.uint32), own_periodic[mine], b"".join(packed))
            used, which = np.unique(segment[seen], return_inverse=True)
            yield b, 2, self.number, _pack(zstd, local[string[seen]], which.astype(np.uint32), place[seen], ids[used], rows[used])


_EXCHANGE = pa.schema([("bucket", pa.int32()), ("step", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_SPANS = pa.schema([(c, pa.int64()) for c in ("doc_id", "row", "start", "end")])


@dataclass
class Strings:
    """The kept strings of a bucket."""

    mins: np.ndarray
    data: list[bytes]
    n: np.ndarray
    smallest: np.ndarray
    count: np.ndarray
    periodic: np.ndarray


#: Covered windows of each string: (first window, past last, smallest document that has them).
Answer = list[list[tuple[int, int, int]]]


class Bucket:
    """Reads the rows of one bucket in order."""

    def __init__(self, kind: Kind, solve: Callable[[Strings, Kind], Answer]) -> None:
        self.kind, self.solve = kind, solve
        self.mins: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.repeated: np.ndarray | None = None
        self.parts: list[tuple] = []
        self.local: dict[int, np.ndarray] = {}
        self.kept = 0
        self.answers: Answer | None = None

    def minimisers(self, chunk: int, blob: bytes) -> None:
        self.mins[chunk] = _unpack(blob)

    def strings(self, chunk: int, blob: bytes) -> None:
        if self.repeated is None:
            values, times = np.unique(np.concatenate([np.append(m, m[twice]) for m, twice in self.mins.values()]), return_counts=True)
            self.repeated = values[times > 1]
        mins = self.mins.pop(chunk)[0]
        keep = np.flatnonzero(np.isin(mins, self.repeated))
        local = np.full(len(mins), -1, np.int64)
        local[keep] = self.kept + np.arange(len(keep))
        self.local[chunk] = local
        self.kept += len(keep)
        if len(keep):
            sizes, n, smallest, count, periodic, data = _unpack(blob)
            ends = np.cumsum(sizes.astype(np.int64))
            self.parts.append((mins[keep], [data[e - s : e] for s, e in zip(sizes[keep].tolist(), ends[keep].tolist(), strict=True)], n[keep], smallest[keep], count[keep], periodic[keep]))

    def occurrences(self, chunk: int, blob: bytes) -> Iterator[tuple[int, int, int, int]]:
        if self.answers is None:
            joined = zip(*self.parts, strict=True) if self.parts else []
            columns = [[x for part in c for x in part] if isinstance(c[0], list) else np.concatenate(c) for c in joined]
            self.answers = self.solve(Strings(*columns), self.kind) if columns else []
            self.parts = []
        local = self.local.pop(chunk)
        string, which, place, ids, rows = _unpack(blob)
        at = local[string]
        some = np.flatnonzero(at >= 0)
        more = self.kind.window - 1
        for s, d, p in zip(at[some].tolist(), which[some].tolist(), place[some].tolist(), strict=True):
            for first, last, smallest in self.answers[s]:
                if smallest < ids[d]:
                    yield ids[d], rows[d], p + first, p + last + more


def common_runs(source: DataFrame, kind: Kind, size: int) -> np.ndarray | None:
    """Marks of the runs that a sample of the texts has most often; None if there are none.

    A text is sampled by its hash, whole, about ``SAMPLE_BYTES`` in all.
    """
    parts = max(1, size // max(SAMPLE_BYTES, size // SAMPLE_SHARE))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_by_bytes(whole, "text", 2 << 20):
                data = b"\n".join(utf8(batch.column("text")))
                for at in range(0, max(1, len(data)), 2 << 20):
                    runs, times = np.unique(kind.grams(data[at : at + (2 << 20)]), return_counts=True)
                    some = times > 1
                    yield pa.RecordBatch.from_arrays([pa.array(runs[some].view(np.int64)), pa.array(times[some])], ["run", "times"])

    sample = source.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).select("text").mapInArrow(count, "run long, times long")
    often = sample.groupBy("run").agg(F.sum("times").alias("times")).where(F.col("times") >= COMMON_TIMES).orderBy(F.desc("times"), "run").limit(COMMON).collect()
    if not often:
        return None
    marks = np.zeros(1 << MARK_BITS, bool)
    marks[np.array([r["run"] for r in often], np.int64).view(np.uint64) >> np.uint64(64 - MARK_BITS)] = True
    return marks


def covered(docs: DataFrame, kind: Kind, solve: Callable[[Strings, Kind], Answer], chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Unit ranges of ``docs`` that answered windows cover: doc_id (NO_ID for null), row, start, end.

    ``docs`` has (doc_id, text); ranges of a document may overlap.
    """
    source = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), row_key().alias("row"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-3 * size // bucket_bytes)))
    chunk_bytes = max(chunk_bytes, min(8 * chunk_bytes, buckets * ROW_BYTES))
    kind = replace(kind, common=common_runs(source, kind, size))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = Chunk(kind, buckets, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), utf8(batch.column("text")), strict=True):
                for first, part in kind.segments(text):
                    chunk.add(doc_id, row, first, part)
                    if chunk.size >= chunk_bytes:
                        yield from _batches(chunk)
                        chunk = Chunk(kind, buckets, chunk.number + 1)
                        release()
        yield from _batches(chunk)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, state = None, Bucket(kind, solve)
        out: list[tuple[int, int, int, int]] = []
        for batch in batches:
            blobs = batch.column("blob")
            for i, (b, step, chunk) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "step", "chunk")), strict=True)):
                blob = blobs[i].as_py()
                if b != bucket:
                    bucket, state = b, Bucket(kind, solve)
                if step == 0:
                    state.minimisers(chunk, blob)
                elif step == 1:
                    state.strings(chunk, blob)
                else:
                    out.extend(state.occurrences(chunk, blob))
                    if len(out) > 100_000:
                        yield _span_batch(out)
                        out = []
        yield _span_batch(out)
        release()

    sent = source.mapInArrow(send, "bucket int, step int, chunk long, blob binary")
    tasks = min(buckets, MOST_TASKS)
    return sent.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).sortWithinPartitions("bucket", "step", "chunk").mapInArrow(receive, SPANS)


def _batches(chunk: Chunk) -> Iterator[pa.RecordBatch]:
    for row in chunk.rows():
        yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, _EXCHANGE, strict=True)], schema=_EXCHANGE)


def _span_batch(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = np.array(out, np.int64).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], schema=_SPANS)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text, spans): each row of ``docs`` with its ranges, gathered by document.

    Rows that repeat a doc_id and text have the same ranges, which count once.
    """
    gathered = spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumnsRenamed({"doc_id": "span_id", "row": "span_row"})
    keyed = docs.withColumns({"row": row_key(), "key": F.coalesce("doc_id", F.lit(NO_ID))})
    return keyed.join(gathered, (F.col("key") == F.col("span_id")) & (F.col("row") == F.col("span_row")), "left").select("doc_id", "text", "spans")


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted, disjoint, maximal ranges."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def groups(mins: np.ndarray) -> list[np.ndarray]:
    """Positions of equal values, together."""
    by = np.argsort(mins, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(mins[by])) + 1) if len(by) else []


def refined(kind: Kind, k: int, strings: list[bytes]) -> Iterator[list[tuple[bytes, int, int, int, bool]]]:
    """Packed strings cut again by longer minimisers, one list for each minimiser.

    A minimiser that very many strings share, such as a common phrase, makes a
    group too large to sort at once; equal windows stay together under any
    minimiser.  Entries: (string, its number, first window, windows, whether the
    minimiser comes again in it).  A list of one entry that isn't periodic can
    hold no repeat and is left out.
    """
    finer = Kind(kind.words, kind.window, k)
    found, blocks, at, size = [], [], 0, 0
    for i, s in enumerate(strings):
        size += len(s)
        if size >= BLOCK_BYTES or i + 1 == len(strings):
            data, low, high, segment, place, n, value, again = finer.runs(strings[at : i + 1])
            found.append((value, np.full(len(low), len(blocks)), low, high, segment + at, place, n, again))
            blocks.append(data)
            at, size = i + 1, 0
    value, block, low, high, owner, place, n, again = (np.concatenate(c) for c in zip(*found, strict=True))
    for group in groups(value):
        if len(group) > 1 or again[group[0]]:
            yield [(blocks[block[e]][low[e] : high[e]], int(owner[e]), int(place[e]), int(n[e]), bool(again[e])) for e in group.tolist()]

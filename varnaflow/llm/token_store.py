"""Token-id output: independent zstandard frames with a trailing seek table.

A shard file holds the ids of its documents, in ascending doc_id order, as one
stream of little-endian unsigned 32-bit integers.  The stream is cut into frames
of about ``FRAME_IDS`` ids, each compressed alone with its own checksum.  Index
frames follow, of ``INDEX_DOCS`` documents each (doc_id, first id, number of ids), and
one frame with the first doc_id of each of them; the file ends with the seek table of
the public zstandard seekable format, written with checksums (the low 32 bits of each
frame's XXH64).  A reader needs the seek table, the list of index frames, and the index
frames and frames of the wanted documents, nothing else.

At scale: one range shuffle by doc_id puts documents in order; shards are written
where they land, a new one whenever one is full of ids or documents, so neither a
file nor what its writer holds grows with the corpus.  A file's name is new for each attempt and enters the manifest
only after it was closed, so a task that runs twice leaves an unlisted file and
nothing else.  The manifest has one row per file; starts are summed over it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, new_path, stored, texts
from .encoding import encoder

FRAME_IDS = 1 << 16
#: A shard is full at so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 26, 1 << 18
INDEX_DOCS = 4096
#: Words whose ids a worker keeps.
MEMO = 1_000_000
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("first", "<u8"), ("n", "<u8")])

MANIFEST = "shard int, part int, file string, n_docs long, n_tokens long, n_frames long, n_bytes long"


class ShardWriter:
    """Writes one shard; ``add`` documents in order, then ``close``."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3, index_docs: int = INDEX_DOCS) -> None:
        self.sink, self.frame_bytes, self.index_docs = sink, 4 * frame_ids, index_docs
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.seek: list[bytes] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.index: list[bytes] = []
        self.firsts: list[tuple[int, int, int, int]] = []
        self.waiting: list[bytes] = []
        self.waits = self.n_tokens = self.n_docs = self.written = 0

    def _frame(self, data: bytes) -> None:
        out = self.zstd.compress(data)
        self.sink.write(out)
        self.written += len(out)
        self.seek.append(ENTRY.pack(len(out), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.waits:
            data = b"".join(self.waiting)
            for i in range(0, len(data), 16 * self.frame_bytes):  # a very long document has several frames
                self._frame(data[i : i + 16 * self.frame_bytes])
            self.waiting, self.waits = [], 0

    def _pack(self) -> None:
        """Documents as an index frame; frames wait for the end of the file."""
        if self.docs:
            self.firsts.append(self.docs[0])
            self.index.append(np.array(self.docs, INDEX).tobytes())
            self.docs = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.n_tokens, len(ids) // 4))
        self.n_docs += 1
        if len(self.docs) == self.index_docs:
            self._pack()
        self.n_tokens += len(ids) // 4
        self.waiting.append(ids)
        self.waits += len(ids)
        if self.waits >= self.frame_bytes:
            self._flush()

    def close(self) -> None:
        self._flush()
        self._pack()
        self.n_frames = len(self.seek)
        for data in self.index:
            self._frame(data)
        self._frame(np.array(self.firsts, INDEX).tobytes())
        body = b"".join(self.seek) + FOOTER.pack(len(self.seek), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.written += 8 + len(body)
        self.sink.close()


class ShardReader:
    """Random access to a shard; only the frames asked for are read and decompressed."""

    def __init__(self, path: str) -> None:
        self.read_frames = 0
        system, name = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError(f"{path} has no seek table with checksums")
        table = np.frombuffer(self._at(size - FOOTER.size - n * ENTRY.size, n * ENTRY.size), "<u4").reshape(n, 3).astype("i8")
        self.sizes, self.raw, self.sums = table.T
        self.places = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ends = np.concatenate([[0], np.cumsum(self.raw)])
        self.firsts = np.frombuffer(self.frame(n - 1), INDEX)
        self.n_frames = n - 1 - len(self.firsts)
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, n: int) -> bytes:
        return self.file.read_at(int(n), int(start))

    def frame(self, k: int) -> bytes:
        self.read_frames += 1
        data = zstandard.ZstdDecompressor().decompress(self._at(self.places[k], self.sizes[k]), max_output_size=int(self.raw[k]) or 1)
        if len(data) != self.raw[k] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} fails its checksum")
        return data

    def ids(self, first: int, n: int) -> bytes:
        """``n`` ids from the ``first`` of the stream, as bytes."""
        start, end, out = 4 * first, 4 * (first + n), []
        k = int(np.searchsorted(self.ends, start, "right")) - 1
        while start < end:
            if self.last[0] != k:
                self.last = (k, self.frame(k))
            base = int(self.ends[k])
            out.append(self.last[1][start - base : end - base])
            start, k = int(self.ends[k + 1]), k + 1
        return b"".join(out)

    def index(self, k: int) -> np.ndarray:
        """The documents of the k-th index frame."""
        return np.frombuffer(self.frame(self.n_frames + k), INDEX)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.firsts)):
            for doc_id, null, first, n in self.index(k).tolist():
                yield (None if null else doc_id), self.ids(first, n)

    def find(self, doc_id: int) -> list[bytes]:
        """The ids of each document with this doc_id; reads the index frames that may hold it."""
        begins = [(not null, i if not null else 0) for i, null in zip(self.firsts["doc_id"].tolist(), self.firsts["null"].tolist(), strict=True)]
        low, high = bisect_left(begins, (True, doc_id)), bisect_right(begins, (True, doc_id))
        found = []
        for k in range(max(0, low - 1), high):
            index = self.index(k)
            found += [self.ids(int(x["first"]), int(x["n"])) for x in index[(index["doc_id"] == doc_id) & (index["null"] == 0)]]
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, frame_ids: int = FRAME_IDS, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS, index_docs: int = INDEX_DOCS) -> DataFrame:
    """Encode all of ``docs`` to shard files in ``path``; returns the stored manifest.

    A null text is empty, a null doc_id comes first, rows that repeat a doc_id are
    documents of their own (in order of a hash of their texts), a long text has
    frames of its own, and an empty table gives an empty manifest.  A shard ends with
    the document that brings it to ``shard_ids`` ids or ``shard_docs`` documents.
    ``path`` is a URI or absolute path that every executor can write through pyarrow.fs.
    """
    end = struct.pack("<I", end_id)

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, writer, name = TaskContext.get().partitionId(), 0, None, ""

        def closed() -> pa.RecordBatch:
            writer.close()
            row = (shard, part, name, writer.n_docs, writer.n_tokens, writer.n_frames, writer.written)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], ["shard", "part", "file", "n_docs", "n_tokens", "n_frames", "n_bytes"])

        encode = encoder(tokenizer, MEMO).encode_many
        for whole in rows:
            for batch in batches_by_bytes(whole, "text", 4 << 20):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                    if writer is None:
                        name = f"{path}/shard-{shard:06d}-{part:06d}-{uuid.uuid4().hex}.zst"
                        system, base = pafs.FileSystem.from_uri(path)
                        system.create_dir(base, recursive=True)
                        writer = ShardWriter(system.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None), frame_ids, index_docs=index_docs)
                    writer.add(doc_id, ids + end)
                    if writer.n_tokens >= shard_ids or writer.n_docs >= shard_docs:
                        yield closed()
                        part, writer = part + 1, None
        if writer:
            yield closed()

    wanted = texts(docs)
    # as many ranges as the table has splits, where those are more than the session's number
    splits = wanted.rdd.getNumPartitions()
    number = [splits] if splits > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    ordered = wanted.withColumn("tie", F.xxhash64("text")).repartitionByRange(*number, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, out = ShardReader(file), []
                for doc_id, ids in reader.documents():
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    total = F.sum("n_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("file", F.coalesce(total, F.lit(0)).alias("start"))
    # a task for each file: their rows are tiny, and left alone would be coalesced into one task
    return placed.repartition(max(1, manifest.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder of the shared store and report from the files.

    Nulls, repeated rows, long texts and empty tables are treated as ``write_shards``
    says; other columns of ``docs`` are not read.
    """
    manifest = write_shards(docs, new_path(docs.sparkSession, "tokens"), tokenizer, end_id)
    return read_shards(manifest)

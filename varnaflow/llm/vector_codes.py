"""Compression of vectors to codes of one byte a part, with codebooks fitted by delta-maintained Lloyd rounds.

Components become whole numbers, vectors are cut into equal consecutive parts, and
each part position has a codebook.  All arithmetic is on whole numbers, so results
are the same on every run and partitioning.

A round reads the vectors with the codes of the round before, gives each part its
nearest entry, and writes the vectors with the new codes.  The running sums and
counts of the entries stay from round to round: a task adds a part to its new entry
and takes it from its old one only where the two differ, and writes one row for each
entry that it touched.  Only these rows are shuffled.  What the driver holds are the
codebooks and the running sums: entries times dimensions numbers, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_path
from .common import release, remove

#: Components that scale to more than this are refused: squared distances must fit 64 bits.
MOST = 1 << 28
#: Below this, distances are exact in double precision.
_EXACT = 1 << 20
#: Rows that one product of matrices takes.
_TOGETHER = 2048

#: What a round writes: vectors with their codes, and what it adds to entries.
_TYPES = {"vec_id": "long", "label": "string", "no_label": "boolean", "q": "array<int>", "code": "binary", "error": "long", "part": "int", "entry": "int", "n": "long", "sums": "array<long>", "kind": "string"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
_ROUND = ", ".join(f"{c} {t}" for c, t in _TYPES.items())


@dataclass
class Codes:
    """``table``: (vec_id, label, code binary, error); ``codebooks``: (parts, entries, width) whole numbers; ``changed``: parts moved in each round."""

    table: DataFrame
    codebooks: np.ndarray
    scale: int
    changed: list[int]


def _whole(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, no_label, q): rows whose components are all finite numbers, as whole numbers of 1/scale."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform(v, lambda x: F.floor(x * scale).cast("int"))
    label = F.col(label_col)
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), label.isNull().alias("no_label"), F.when(F.forall(v, lambda x: F.abs(x) * scale <= MOST), q).otherwise(F.raise_error(F.lit(f"a component beyond {MOST}/{scale}"))).alias("q"))


def nearest(q: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest row of ``book`` for each row of ``q``, ties to the lower, and the squared distance."""
    index = np.zeros(len(q), np.int64)
    if not book.shape[1]:
        return index, np.zeros(len(q), np.int64)
    most = max(int(np.abs(q).max(initial=0)), int(np.abs(book).max(initial=0)))
    if most * most * book.shape[1] < (1 << 51):
        b, half = book.astype(np.float64).T, (book.astype(np.float64) ** 2).sum(1)
        for i in range(0, len(q), _TOGETHER):  # |b|^2 - 2qb orders entries as the distance does
            index[i : i + _TOGETHER] = (half - (2.0 * q[i : i + _TOGETHER]) @ b).argmin(1)
    else:
        b = book.astype(np.int64)
        for i in range(0, len(q), 64):
            index[i : i + 64] = ((q[i : i + 64, None, :].astype(np.int64) - b) ** 2).sum(2).argmin(1)
    return index, ((q.astype(np.int64) - book[index]) ** 2).sum(1)


def _assign(rows: DataFrame, books: np.ndarray, path: str, last: bool) -> None:
    """Write rows with their new codes, and what changed for each entry, as two kinds of one table."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        touched = np.zeros((parts, entries), bool)

        def out(rows: int, /, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c].cast(_ARROW[t]) if c in columns else pa.nulls(rows, _ARROW[t]) for c, t in _TYPES.items()], list(_TYPES))

        for batch in batches:
            n = batch.num_rows
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
            old = batch.column("code").to_pylist()
            was = None if not n or old[0] is None else np.frombuffer(b"".join(old), np.uint16).reshape(n, parts)
            now, error = np.zeros((n, parts), np.uint16), np.zeros(n, np.int64)
            for p in range(parts):
                now[:, p], distance = nearest(q[:, p], books[p])
                error += distance
            if not last:
                for p in range(parts):
                    moved = slice(None) if was is None else np.flatnonzero(now[:, p] != was[:, p])
                    for to, sign in ((now, 1), (was, -1)):
                        if to is not None:
                            e = to[moved, p]
                            np.add.at(sums[p], e, sign * q[moved, p].astype(np.int64))
                            np.add.at(counts[p], e, sign)
                            touched[p, e] = True
            codes = pa.array([x.tobytes() for x in now], pa.binary())
            kept = {} if last else {"q": batch.column("q")}
            yield out(n, vec_id=batch.column("vec_id"), label=batch.column("label"), no_label=batch.column("no_label"), code=codes, error=pa.array(error), kind=pa.array(["vector"] * n), **kept)
        release()
        p, e = np.nonzero(touched)
        if len(p):
            yield out(len(p), part=pa.array(p), entry=pa.array(e), n=pa.array(counts[p, e]), sums=pa.array(list(sums[p, e]), pa.list_(pa.int64())), kind=pa.array(["delta"] * len(p)))

    rows.mapInArrow(run, _ROUND).write.partitionBy("kind").parquet(path)


def _read(rows: DataFrame, path: str, kind: str, *columns: str) -> DataFrame:
    return rows.sparkSession.read.schema(_ROUND).parquet(path).where(F.col("kind") == kind).select(*columns)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, scale: int = 1024, rounds: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes of all vectors, and the codebooks.

    Rows whose vector is null or holds a null, NaN or infinite component are dropped.
    Codebooks begin with the parts of the ``entries`` rows of smallest id (null ids
    last, equal ids by vector), or of all rows if there are fewer; an entry that no
    part uses stays as it is.  Vectors need one length, a multiple of ``parts``: a
    table with others is refused.  Repeated rows count as often as they stand there;
    other columns are not read.  An empty table gives no codes and empty codebooks.
    """
    if not 0 < entries <= 1 << 16:
        raise ValueError("codes take two bytes at most")
    whole = _whole(vectors, id_col, vector_col, label_col, scale)
    first = [r["q"] for r in whole.select("vec_id", "q").orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()]  # at most ``entries`` rows
    dims = len(first[0]) if first else 0
    if dims % parts:
        raise ValueError(f"vectors of {dims} components don't cut into {parts} parts")
    books = np.array(first, np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    fits = F.when(F.size("q") == dims, F.col("q")).otherwise(F.raise_error(F.lit(f"a vector hasn't {dims} components")))
    rows = whole.select("vec_id", "label", "no_label", fits.alias("q"), F.lit(None).cast("binary").alias("code"))
    sums = [[[0] * (dims // parts) for _ in first] for _ in range(parts)]
    counts = [[0] * len(first) for _ in range(parts)]
    changed, before = [], None
    for k in range(rounds + 1 if first else 0):
        path = new_path(vectors.sparkSession, "codes")
        _assign(rows, books, path, last=k == rounds)
        rows = _read(vectors, path, "vector", "vec_id", "label", "no_label", "q", "code")
        if before:  # the vectors stand in the new table now
            remove(vectors.sparkSession, before)
        before = path
        if k == rounds:
            break
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims // parts)]
        deltas = _read(vectors, path, "delta", "part", "entry", "n", "sums").groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()  # one row an entry
        changed.append(sum(max(0, r["n"]) for r in deltas))
        for r in deltas:
            p, e = r["part"], r["entry"]
            counts[p][e] += r["n"]
            sums[p][e] = [a + b for a, b in zip(sums[p][e], r[3:], strict=True)]
            if counts[p][e]:
                books[p, e] = [a // counts[p][e] for a in sums[p][e]]
    if not first:
        empty = vectors.sparkSession.createDataFrame([], "vec_id long, label string, no_label boolean, code binary, error long")
        return Codes(empty, books, scale, changed)
    return Codes(_read(vectors, before, "vector", "vec_id", "label", "no_label", "code", "error"), books, scale, changed)


def code_bytes(code: bytes) -> list[int]:
    """The entry of each part."""
    return np.frombuffer(code, np.uint16).tolist()


def decompressed(codes: Codes) -> DataFrame:
    """(vec_id, vector): each vector as its entries stand for it."""
    books, scale = codes.codebooks, codes.scale

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vector(code: pa.Array) -> pa.Array:
        index = np.frombuffer(b"".join(code.to_pylist()), np.uint16).reshape(len(code), len(books)) if len(code) else np.zeros((0, len(books)), np.uint16)
        whole = np.concatenate([book[index[:, p]] for p, book in enumerate(books)], axis=1) / scale
        return pa.array(list(whole), pa.list_(pa.float64()))

    return codes.table.select("vec_id", vector("code").alias("vector"))


def hex_code(code: Column) -> Column:
    """The low byte of each entry number in hex: two digits a part."""
    digits = F.hex(code)
    n = (F.length(digits) / 4).cast("int")
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, 4 * i + 1, F.lit(2))), ""))


def label_errors(table: DataFrame) -> DataFrame:
    """``table`` with the error summed over rows of its label; those without one are a label of their own."""
    sums = table.groupBy("no_label", "label").agg(F.sum("error").alias("label_error")).select(F.col("no_label").alias("_none"), F.coalesce("label", F.lit("")).alias("_label"), "label_error")
    return table.join(sums, (F.col("no_label") == F.col("_none")) & (F.coalesce("label", F.lit("")) == F.col("_label"))).drop("_none", "_label")

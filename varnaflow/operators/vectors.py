"""Word vectors of hashed subwords, and nearest neighbours by inverted lists.

Training is skip-gram with negative sampling.  A word's vector is the mean of the
vectors of its character n-grams and of itself, all hashed into a table of fixed
size, so spelling variants share most of theirs and unseen words have one too.  An
epoch hands the tables to every partition, each learns over its own sentences, some
hundred words at a time in NumPy, and what they learnt is merged: the mean of each
table row over the partitions that changed it, weighted by how often.  The tables are
all that the driver holds: ``buckets`` times ``dim`` numbers each, whatever the corpus.

Searching: centroids are fitted on a bounded sample, every vector joins the list of its
nearest, and a query looks through the lists nearest to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scans import kept


@dataclass(frozen=True)
class Shape:
    dim: int = 32
    buckets: int = 1 << 14
    least: int = 3
    most: int = 5
    window: int = 4
    negatives: int = 5
    rate: float = 0.05


def _codes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` code points that follow one another."""
    out = np.full(max(0, len(points) - n + 1), n, np.uint32)
    for k in range(n):
        out = (out ^ points[k : k + len(out)]) * np.uint32(0x9E3779B1)
        out ^= out >> np.uint32(15)
    return out


def _grams(words: list[str], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word how many different table rows its n-grams and itself have, these rows one word after another, and the row of itself; no word by itself."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    begins, of = ends - lengths, np.repeat(np.arange(len(words)), lengths)
    # a word itself is a sum over its points, each hashed with its place
    placed = ((points ^ ((np.arange(len(points)) - begins[of]).astype(np.uint32) * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)).astype(np.uint32)
    placed ^= placed >> np.uint32(13)
    own = np.add.reduceat(placed * np.uint32(0x27D4EB2F), begins, dtype=np.uint32) if len(words) else placed
    own = ((own ^ (own >> np.uint32(16))) % np.uint32(shape.buckets)).astype(np.int64)
    keys = [np.arange(len(words)) * shape.buckets + own]
    for n in range(shape.least, shape.most + 1):
        inside = np.flatnonzero(np.arange(max(0, len(points) - n + 1)) + n <= ends[of[: max(0, len(points) - n + 1)]])
        keys.append(of[inside] * shape.buckets + (_codes(points, n)[inside] % np.uint32(shape.buckets)).astype(np.int64))
    each = np.sort(np.concatenate(keys))  # np.unique takes several times as long
    each = each[np.r_[True, each[1:] != each[:-1]]] if len(each) else each
    return np.bincount(each // shape.buckets, minlength=len(words)), each % shape.buckets, own


#: Words that learn from the same state of the tables, how many changes of one row among them count in full, and the words they are all told apart from.
_TOGETHER, _STEADY, _AGAINST = 1024, 32, 256


def _sums(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of rows between ``begins``; two numbers are added as one complex number, in half as many steps."""
    if x.shape[1] % 2:
        return np.add.reduceat(x, begins)
    return np.add.reduceat(np.ascontiguousarray(x, np.float32).view(np.complex64), begins).view(np.float32)


def _product(a: np.ndarray, b: np.ndarray, rows: int = 32) -> np.ndarray:
    """``a @ b``, some rows at a time: products so small are not dealt to threads, which the other tasks' cores would have to run."""
    whole = len(a) // rows * rows
    out = np.empty((len(a), b.shape[1]), np.float32)
    np.matmul(a[:whole].reshape(-1, rows, a.shape[1]), b, out=out[:whole].reshape(-1, rows, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def _add(table: np.ndarray, hits: np.ndarray, rows: np.ndarray, change: np.ndarray, of: np.ndarray, times: np.ndarray) -> None:
    """Add ``change[of]`` to ``rows``, which may come again; ``times[of]`` says how many changes each holds.  More than ``_STEADY`` of a row count as so many."""
    # sorting 16 bits takes a pass or two
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")
    sorted_, of = rows[order], of[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    n, met = np.add.reduceat(times[of], first), sorted_[first]
    size = np.diff(np.r_[first, len(rows)])
    again = size > 1
    total = np.take(change, of[first], axis=0)  # most rows come once; sums of one take as long as of many
    if again.any():
        total[again] = _sums(np.take(change, of[np.repeat(again, size)], axis=0), np.cumsum(size[again]) - size[again])
    total *= np.minimum(1, _STEADY / np.maximum(n, 1)).astype(np.float32)[:, None]
    table[met] += total
    hits[met] += n


def _pass(sentences: pa.ListArray, inner: np.ndarray, outer: np.ndarray, shape: Shape, rate: float, seed: int) -> np.ndarray:
    """One pass of skip-gram; changes both tables, returns how often each row changed.

    Words lie side by side, so what is near them are slices of one array.  All words of a
    step are told apart from the same ``_AGAINST`` others in one product of matrices, each
    of which counts as its share of ``negatives``.
    """
    rnd = np.random.default_rng(seed)
    hits = np.zeros((2, shape.buckets), np.int64)
    coded = sentences.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    if not known:
        return hits
    of = coded.indices.to_numpy().astype(np.int64)
    sizes, flat, own = _grams(known, shape)
    begins = np.cumsum(sizes) - sizes
    # what is told apart from a word's neighbours are words of all these sentences, as often as they stand there
    pool = own[of]
    lengths = sentences.value_lengths().to_numpy()
    ends = np.repeat(np.cumsum(lengths), lengths)
    starts = ends - np.repeat(lengths, lengths)
    w = shape.window
    around = np.r_[np.zeros(w, np.int64), pool, np.zeros(w, np.int64)]
    aside = np.r_[-w:0, 1 : w + 1]
    share = shape.negatives / _AGAINST
    for at in range(0, len(of), _TOGETHER):
        size = min(_TOGETHER, len(of) - at)
        place = np.arange(at, at + size)[:, None] + aside
        reach = rnd.integers(1, w + 1, size)
        near = (np.abs(aside) <= reach[:, None]) & (place >= starts[at : at + size, None]) & (place < ends[at : at + size, None])
        learns = near.any(1)
        against = pool[rnd.integers(0, len(pool), _AGAINST)]
        if not learns.any():
            continue
        here, which, times = np.unique(of[at : at + size], return_inverse=True, return_counts=True)
        n = sizes[here]
        begin = np.cumsum(n) - n
        row_of = np.repeat(np.arange(len(here)), n)
        rows = flat[np.arange(len(row_of)) + (begins[here] - begin)[row_of]]
        means = _sums(np.take(inner, rows, axis=0), begin) / n[:, None].astype(np.float32)
        v, ids = means[which], around[at : at + size + 2 * w]
        out, apart = np.take(outer, ids, axis=0), np.take(outer, against, axis=0)
        beside = [out[w + k : w + k + size] for k in aside]
        score = np.stack([np.einsum("ij,ij->i", v, o) for o in beside], 1)
        error = np.where(near, (1 - 1 / (1 + np.exp(-np.clip(score, -8, 8)))) * rate, 0).astype(np.float32)
        other = _product(v, -apart.T)
        np.exp(np.clip(other, -8, 8, out=other), out=other)
        other += 1
        np.divide((learns * (-rate * share)).astype(np.float32)[:, None], other, out=other)
        steps, change = _product(other, apart), np.zeros((len(ids) + _AGAINST, shape.dim), np.float32)
        for j, k in enumerate(aside):
            steps += error[:, j, None] * beside[j]
            change[w + k : w + k + size] += error[:, j, None] * v
        change[len(ids) :] = _product(other.T.copy(), v, 8)
        counts = np.zeros(len(change), np.int64)
        for j, k in enumerate(aside):
            counts[w + k : w + k + size] += near[:, j]
        counts[len(ids) :] = max(1, round(learns.sum() * share))
        order = np.argsort(which, kind="stable")
        steps = _sums(np.take(steps, order, axis=0), np.cumsum(times) - times)
        every = np.arange(len(change))[some := counts > 0]
        _add(outer, hits[1], np.r_[ids, against][some], change, every, counts)
        _add(inner, hits[0], rows, steps, row_of, np.bincount(which, learns, len(here)).astype(np.int64))
    return hits


def train(sentences: DataFrame, words: str = "words", epochs: int = 3, partitions: int = 16, shape: Shape = Shape(), seed: int = 27) -> np.ndarray:  # noqa: B008
    """The table of subword vectors, learnt from an array column.

    Sentences are dealt by a hash of their words to ``partitions`` and sorted there, so
    the same sentences give the same table.  Nulls, and sentences of one word, teach nothing.
    """
    dealt = sentences.select(F.col(words).alias("ws")).where(F.size("ws") > 1)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("ws"), F.lit(partitions)).cast("int"))
    dealt = kept(dealt, "sentences") if epochs > 1 else dealt
    rnd = np.random.default_rng(seed)
    inner = ((rnd.random((shape.buckets, shape.dim)) - 0.5) / shape.dim).astype(np.float32)
    outer = np.zeros((shape.buckets, shape.dim), np.float32)
    for epoch in range(epochs):
        rate = shape.rate * (1 - epoch / epochs)
        context = dealt.sparkSession.sparkContext
        model = context.broadcast((inner, outer))  # of the size that ``shape`` says

        def learn(batches: Iterator[pa.RecordBatch], rate: float = rate, epoch: int = epoch, model=model) -> Iterator[pa.RecordBatch]:  # noqa: ANN001, B023
            tables = [x.copy() for x in model.value]
            hits = np.zeros((2, shape.buckets), np.int64)
            for batch in batches:
                hits += _pass(batch.column("ws"), *tables, shape, rate, seed + epoch)
            for kind in (0, 1):
                rows = np.flatnonzero(hits[kind])
                change = (tables[kind][rows] - model.value[kind][rows]) * hits[kind][rows, None].astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows.astype(np.int32)), pa.array(hits[kind][rows]), _lists(change)], ["kind", "row", "n", "change"])

        rows = dealt.repartition(partitions, "part").sortWithinPartitions("part", "ws").select("ws")
        # dealt before they are summed: partial sums would be no fewer, and twice as wide
        changes = rows.mapInArrow(learn, "kind int, row int, n long, change array<float>").repartition("kind", "row")
        sums = [F.sum(F.col("change")[i]).alias(f"c{i}") for i in range(shape.dim)]
        merged = changes.groupBy("kind", "row").agg(F.sum("n").alias("n"), *sums).collect()  # a row for each row of the tables at most
        for r in merged:
            (inner, outer)[r["kind"]][r["row"]] += np.array(r[3:]) / r["n"]
        model.destroy()
    return inner


def word_vectors(words: DataFrame, table: np.ndarray, column: str = "word", shape: Shape = Shape()) -> DataFrame:  # noqa: B008
    """``words`` with ``vector``: the mean of each word's subword vectors, of length one."""
    context = words.sparkSession.sparkContext
    model = context.broadcast(table)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vector(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float32()))
        sizes, rows, _ = _grams([w or "" for w in column.to_pylist()], shape)
        out = np.add.reduceat(model.value[rows], np.cumsum(sizes) - sizes)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return _lists(out)

    return words.withColumn("vector", vector(column))


def centroids(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8, id_col: str = "id", vector_col: str = "vector") -> np.ndarray:
    """Centres of ``lists`` lists, by k-means on the ``sample`` vectors whose ids have the least hashes."""
    rows = vectors.select(F.md5(F.col(id_col).cast("string").cast("binary")).alias("h"), F.col(vector_col).alias("v")).orderBy("h", "v").limit(sample).collect()  # bounded
    x = np.array([r["v"] for r in rows], np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        of = (x @ centre.T).argmax(1)
        for k in range(len(centre)):
            if (of == k).any():
                centre[k] = x[of == k].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), pa.float32()))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)


def nearest_by_lists(vectors: DataFrame, queries: DataFrame, centre: np.ndarray, k: int = 5, probes: int = 8, id_col: str = "id", vector_col: str = "vector", block: int = 16_384, together: int = 8_192) -> DataFrame:
    """(query, id, cosine): the ``k`` nearest of each query among the vectors of its ``probes`` nearest lists, itself left out.

    Every vector is in one list; lists are cut into blocks of about ``block`` vectors
    by a hash, so a list of any size is spread, and the queries of a list into parts of
    about ``together``.  A part meets each block of its lists in one product of matrices,
    each block gives its ``k`` best, and the best of these are left.  Vectors that are
    null, zero or hold null or non-finite components are in no list.
    """
    dim = centre.shape[1]

    def placed(frame: DataFrame, n: int) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), dim), False))
                x = _matrix(batch.column("v"), dim)
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                batch, x = batch.filter(pa.array(good)), x[good]
                near = x @ centre.T
                lists = near.argmax(1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], ["id", "v", "lists"])

        rows = frame.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
        return rows.mapInArrow(place, "id string, v array<float>, lists array<int>").select("id", "v", F.explode("lists").alias("list"))

    def best_of(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        asked, ids = left.column("id").to_pylist(), right.column("id").to_pylist()
        q, v = _matrix(left.column("v"), dim).astype(np.float64), _matrix(right.column("v"), dim).astype(np.float64)
        q, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, v))
        single, own, wanted = v.T.astype(np.float32), {}, set(asked)
        for i, x in enumerate(ids):
            if x in wanted:
                own.setdefault(x, []).append(i)
        out = [], [], []
        for at in range(0, len(asked) if ids else 0, 256):
            some = asked[at : at + 256]
            near = q[at : at + 256].astype(np.float32) @ single
            for j, x in enumerate(some):
                near[j, own.get(x, [])] = -np.inf
            rows, found = np.arange(len(some)), []
            for _ in range(min(k + 4, len(ids))):  # a few more than asked for: single precision only lists them
                found.append(near.argmax(1))
                near[rows, found[-1]] = -np.inf
            found = np.sort(np.stack(found, 1), axis=1)
            exact = np.einsum("ijd,id->ij", v[found], q[at : at + 256])
            for j, x in enumerate(some):
                mine = [c for c in np.argsort(-exact[j], kind="stable").tolist() if ids[found[j, c]] != x][:k]
                out[0].extend([x] * len(mine))
                out[1].extend(ids[found[j, c]] for c in mine)
                out[2].extend(exact[j, mine].tolist())
        return pa.table([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["query", "id", "cosine"])

    members, asked = kept(placed(vectors, 1), "lists"), kept(placed(queries, probes), "asked")
    counted = lambda frame, size, name: frame.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = F.broadcast(counted(members, block, "blocks").join(counted(asked, together, "parts"), "list"))  # a row a list at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    keys = ["list", "block", "part"]
    left = asked.join(grid, "list").select("list", every("blocks").alias("block"), dealt("parts").alias("part"), "id", "v")
    right = members.join(grid, "list").select("list", dealt("blocks").alias("block"), every("parts").alias("part"), "id", "v")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of, "query string, id string, cosine double")
    best = met.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "id"))), 1, k).alias("best"))
    return best.select("query", F.explode("best").alias("b")).select("query", "b.id", (-F.col("b.c")).alias("cosine"))

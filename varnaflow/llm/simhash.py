"""SimHash near-duplicates by pivot distance tables.

Each text has a 64-bit fingerprint over its word shingles.  Equal fingerprints are
one class, so a group of copies is one row from then on.  For each class a table
row holds its Hamming distances to ``PIVOTS`` reference fingerprints.  By the
triangle inequality two fingerprints within d bits differ by at most d in every
coordinate, so pairs beyond that are dropped without comparing them, and survivors
are verified bit by bit.

To bring pairs together without trying all of them, the 64 bits are cut into d + 2
blocks: fingerprints within d bits agree on two of these at least, so the join is
on every choice of two blocks, and there only where the fingerprints' distances to one
of the pivots fall in the same of its overlapping ranges, which every pair within
d bits does.  A bucket of more than ``DENSE`` fingerprints even so (a family of
near copies) would still make quadratically many pairs; its members instead meet at the fingerprints between them: two fingerprints within two bits
have a common neighbour within one bit, and two that share one are within two
bits.  That is exact for d = 2 and grows linearly; for other d dense buckets are
joined like the rest, and their pairs grow with the square of their size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, stored, texts, utf8
from .graph import components

SEED = 42
PIVOTS = 16
DENSE = 256
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Lower-cases A-Z, hashes each run of ``shingle`` words; zero for no words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    data = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    begin, end = starts[:n].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 18):  # bounded memory for very long texts
        h = np.array([digest(data[s:e], SEED) for s, e in zip(begin[i : i + (1 << 18)], end[i : i + (1 << 18)], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "text"):
                fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints, as signed longs."""
    return [int.from_bytes(xxhash.xxh64(f"pivot {i}").digest(), "big", signed=True) for i in range(n)]


def hamming(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b).cast("long")))


def _block_keys(fp: Column, bits: int) -> Column:
    """An array of (table, key): for each choice of two blocks, the bits there."""
    n = bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    chosen = [masks[i] | masks[j] for i, j in itertools.combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*[F.struct(F.lit(k).alias("table"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")) for k, m in enumerate(signed)])


def _ranges(distance: Column, bits: int) -> Column:
    """The ranges of 2 * bits + 1 distances, one beginning at every bits + 1, that hold ``distance``: one or two."""
    first, last = F.floor(distance / (bits + 1)), F.floor((distance + bits) / (bits + 1))
    return F.when(first == last, F.array(first)).otherwise(F.array(first, last))


def links(classes: DataFrame, bits: int = 2, n_pivots: int = PIVOTS, dense: int = DENSE) -> DataFrame:
    """(u, v) edges that connect all fingerprints within ``bits`` of each other.

    ``classes`` has (fp, rep), one row for each fingerprint.  Sparse buckets give
    every linked pair; dense ones give, for bits = 2, a star around each common
    neighbour, which joins the same fingerprints.
    """
    table = classes.select("fp", "rep", *[hamming(F.col("fp"), p).cast("byte").alias(f"p{i}") for i, p in enumerate(pivots(n_pivots))])
    keyed = table.withColumn("at", F.explode(_block_keys(F.col("fp"), bits))).select("*", "at.table", "at.key").drop("at")
    # each table asks another pivot
    distance = F.element_at(F.array(*[f"p{i}" for i in range(n_pivots)]), F.col("table") % n_pivots + 1)
    keyed = keyed.withColumn("range", F.explode(_ranges(distance, bits)))
    at = ["table", "key", "range"]
    sizes = keyed.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    sparse = sizes.where(F.col("n") <= dense) if bits == 2 else sizes
    bucket = stored(keyed.join(sparse.select(*at), at), "buckets")
    a, b = bucket.alias("a"), bucket.alias("b")
    near = reduce(lambda x, y: x & y, [F.abs(F.col(f"a.p{i}") - F.col(f"b.p{i}")) <= bits for i in range(n_pivots)])
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in at]) & (F.col("a.fp") < F.col("b.fp"))
    edges = a.join(b, same & near & (hamming(F.col("a.fp"), F.col("b.fp")) <= bits)).select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    if bits != 2:
        return edges
    crowded = keyed.join(sizes.where(F.col("n") > dense).select(*at), at).select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    meets = crowded.withColumn("flip", F.explode(flips)).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"), "rep")
    hub = meets.groupBy("middle").agg(F.min("rep").alias("u"), F.max("rep").alias("w")).where("u < w")
    stars = meets.join(hub.select("middle", "u"), "middle").where("rep <> u").select("u", F.col("rep").alias("v")).distinct()
    return edges.unionByName(stars)


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    A null or empty text has fingerprint zero and links like any other.  A row
    with a null doc_id keeps its fingerprint and belongs to the component of its
    fingerprint, but never names it; component_id is null if no row of the
    component has a doc_id.  Repeated rows are repeated in the result.
    """
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")).select("fp", "doc", F.coalesce("doc", F.xxhash64("fp").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))).alias("rep")), "classes")
    found = components(links(classes.select("fp", "rep"), bits)).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("root"), "doc")
    roots = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    return prints.join(named.join(roots, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")

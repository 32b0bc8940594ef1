"""Documents of a given shingle similarity, by long SimHash fingerprints and pivot tables.

Where near copies differ by a fifth of their shingles, 64 bits are too few to tell
them apart from strangers.  Here a fingerprint has ``BITS`` bits, whose share of
differing bits estimates the cosine of the shingle sets and so the similarity.
Pairs are sought where documents agree on a key of ``WIDTH`` least shingle hashes
(of ``KEYS`` such keys); there a table of Hamming distances to ``PIVOTS`` reference
fingerprints discards pairs by the largest difference of a coordinate, the rest are
compared bit by bit, and survivors by their shingle sets: a link is a pair of the
similarity.

Equal texts are one row from the start.  A key that very many documents have is
cut in blocks.  Each block is compared within itself first; then what the links so
far have joined is one family, and blocks are compared with each other only where
they hold different families, each pair of blocks in a task of its own.  So a large
group of near copies costs a time in proportion to its size; texts that share a key
and stay apart still cost the square of their number.  A task gives spanning links
only, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, free_names, stored, utf8
from .graph import components
from .simhash import _LOWER
from .wordhash import mix, run_hashes, word_hashes, word_spans

BITS = 1024
KEYS = 10
WIDTH = 3
PIVOTS = 24
BLOCK = 1024
#: Standard deviations that the filter by bits allows.
DEVIATIONS = 4
#: Shingles that a block may hold where sets are compared.
BLOCK_SHINGLES = 1 << 20


def radius(similarity: float, bits: int = BITS) -> int:
    """Differing bits expected at this similarity, and ``DEVIATIONS`` standard deviations beyond."""
    cosine = 2 * similarity / (1 + similarity)
    share = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the different shingles, in order; a text of fewer words is one shingle."""
    data = text.translate(_LOWER)
    h = word_hashes(data, *word_spans(data))
    return np.unique(run_hashes(h, min(shingle, len(h)))) if len(h) else h


def sketch(h: np.ndarray) -> tuple[bytes, list[int]]:
    """The long fingerprint and the keys of one text's ``shingles``."""
    if not len(h):
        return bytes(BITS // 8), []
    total = np.zeros(BITS, np.int32)
    least = np.full(KEYS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 12):
        part = h[i : i + (1 << 12)]
        for k in range(BITS // 64):
            bits = np.unpackbits(mix(part + np.uint64(k + 1)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int32)
        for k in range(KEYS * WIDTH):
            least[k] = min(least[k], mix(part ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))).min())
    keys = run_hashes(least, WIDTH)[:: WIDTH].view(np.int64)
    return np.packbits(2 * total > len(h), bitorder="little").tobytes(), keys.tolist()


def sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(rep, print, keys) for each row of (rep, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "text"):
                both = [sketch(shingles(t, shingle)) for t in utf8(batch.column("text"))]
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([p for p, _ in both], pa.binary()), pa.array([k for _, k in both], pa.list_(pa.int64()))], ["rep", "print", "keys"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, print binary, keys array<long>")


def _pivots() -> np.ndarray:
    return np.stack([np.frombuffer(b"".join(xxhash.xxh64_digest(f"pivot {i}", k) for k in range(BITS // 64)), np.uint64) for i in range(PIVOTS)])


def _like(sets: list[np.ndarray], i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Those of ``others`` whose shingle sets have this similarity to that of ``i``."""
    mine, sizes = sets[i], np.array([len(sets[j]) for j in others.tolist()], np.int64)
    near = np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine)) - 1e-9
    others, sizes = others[near], sizes[near]
    if not len(others):
        return others
    flat = np.concatenate([sets[j] for j in others.tolist()])
    at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
    shared = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return others[shared * (1 + similarity) >= similarity * (sizes + len(mine)) - 1e-9]


def _compare(table: pa.Table, most: int, similarity: float | None = None) -> pa.Table:
    """Spanning links of one pair of blocks; with ``similarity`` each is a pair of that shingle similarity."""
    rep = table["rep"].to_numpy()
    x = np.frombuffer(b"".join(table["print"].to_pylist()), np.uint64).reshape(len(rep), BITS // 64)
    sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()] if similarity is not None else []
    distance = np.stack([np.bitwise_count(x ^ p).sum(axis=1, dtype=np.int16) for p in _pivots()], axis=1)
    cross = table["low"][0].as_py() != table["high"][0].as_py()
    side = table["block"].to_numpy() == table["low"][0].as_py()
    parent = np.arange(len(rep))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.argsort(distance[:, 0], kind="stable")
    first = distance[order, 0]
    for n, i in enumerate(order.tolist()):
        others = order[n + 1 : np.searchsorted(first, first[n] + most, "right")]  # the first coordinate, by sorting
        if cross:
            others = others[side[others] != side[i]]
        others = others[np.abs(distance[others] - distance[i]).max(axis=1, initial=0) <= most]
        others = others[np.bitwise_count(x[others] ^ x[i]).sum(axis=1, dtype=np.int64) <= most]
        if sets:
            mine = root(i)
            others = _like(sets, i, others[[root(j) != mine for j in others.tolist()]] if len(others) else others, similarity)
        for j in others.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(rep))], np.int64)
    some = np.flatnonzero(roots != np.arange(len(rep)))
    return pa.table([pa.array(rep[some]), pa.array(rep[roots[some]])], schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def spanning(member: DataFrame, at: list[str], compare: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """(u, v): links that connect all pairs that ``compare`` finds among rows with equal ``at``.

    ``member`` has (rep, weight) and what ``compare`` reads besides; rows of a weight
    of 1 in all make a block.
    """
    schema = "u long, v long"
    sizes = member.groupBy(*at).agg(F.count("*").alias("members"), F.ceil(F.sum("weight")).alias("blocks")).where("members > 1").drop("members")
    # within blocks, which the join's own partitioning would keep together
    first = member.join(sizes, at).withColumn("block", F.pmod(F.xxhash64("rep", *at), F.col("blocks")))
    within = stored(first.withColumns({"low": F.col("block"), "high": F.col("block")}).repartition(*at, "block").groupBy(*at, "block").applyInArrow(compare, schema), "links")
    large = sizes.where("blocks > 1")
    if large.isEmpty():
        return within
    # between blocks of different families
    joined = components(within).withColumnRenamed("node", "rep")
    rows = stored(member.join(large.drop("blocks"), at).join(joined, "rep", "left").withColumn("family", F.coalesce("component", "rep")).drop("component"), "families")
    own = rows.groupBy(*at, "family").agg(F.sum("weight").alias("w"))
    rest = own.where("w <= 1").groupBy(*at).agg(F.greatest(F.ceil(F.sum("w")), F.lit(1)).alias("few"))
    placed = rows.join(own, [*at, "family"]).join(rest, at, "left")
    mixed = F.xxhash64(F.lit("rest"), F.pmod(F.xxhash64("family"), F.col("few")))
    alone = F.xxhash64("family", F.pmod(F.xxhash64("rep"), F.ceil("w")))
    placed = stored(placed.withColumns({"big": F.when(F.col("w") > 1, F.col("family")), "block": F.when(F.col("w") > 1, alone).otherwise(mixed)}).drop("w", "few", "family"), "blocks")
    blocks = placed.select(*at, "block", "big").distinct()
    families = blocks.where("big is not null").select(*at, "big").distinct()
    two = families.join(families.withColumnRenamed("big", "other"), at).where("big < other")
    apart = two.join(blocks.where("big is not null").withColumnRenamed("block", "one"), [*at, "big"]).join(blocks.where("big is not null").select(*at, F.col("block").alias("two"), F.col("big").alias("other")), [*at, "other"])
    ends = blocks.where("big is null").select(*at, F.col("block").alias("one")).join(blocks.select(*at, F.col("block").alias("two"), "big"), at).where("big is not null or one <= two")
    pairs = ends.select(*at, "one", "two").unionByName(apart.select(*at, "one", "two")).select(*at, F.least("one", "two").alias("low"), F.greatest("one", "two").alias("high"))
    sides = F.array_distinct(F.array("low", "high"))
    between = placed.join(pairs.withColumn("block", F.explode(sides)), [*at, "block"]).repartition(*at, "low", "high").groupBy(*at, "low", "high").applyInArrow(compare, schema)
    return within.unionByName(between)


def links(prints: DataFrame, most: int, block: int = BLOCK) -> DataFrame:
    """(u, v): links that connect all sketches found within ``most`` bits."""
    placed = stored(prints.select("rep", "print", F.posexplode("keys").alias("n", "key"), F.lit(1 / block).alias("weight")), "keys")
    return spanning(placed, ["n", "key"], lambda t: _compare(t, most))


def confirmed(candidates: DataFrame, shingle: int, similarity: float, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(u, v): links that connect all pairs of the similarity, of rows (rep, component, text), within a component."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "text"):
                sets = [shingles(t, shingle) for t in utf8(batch.column("text"))]
                columns = [batch.column("rep"), batch.column("component"), pa.array([sketch(h)[0] for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "group", "print", "shingles"])

    member = candidates.select("rep", "component", "text").mapInArrow(run, "rep long, group long, print binary, shingles binary")
    weight = F.greatest(F.lit(1 / block), F.octet_length("shingles") / (8 * block_shingles))
    return spanning(stored(member.withColumn("weight", weight), "shingles"), ["group"], lambda t: _compare(t, radius(similarity), similarity))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar ones: the smallest id, ties by row.

    A null text is empty, and texts without words, empty or of white space, are one
    group.  A row with a null id stays only where its group has no id.  Repeated rows
    are one group.  Long texts are read whole.  An empty table gives no rows.  All
    columns stay as they are, whatever their names.
    """
    names = docs.columns
    rep, row, own = free_names(names, "vf_rep", "vf_row", "vf_own")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    text = F.when(F.btrim(text, F.lit(" \t\n\v\f\r")) == "", F.lit("")).otherwise(text)
    # two hashes name a text: 128 bits would have to agree for two texts to be taken for one
    marked = stored(docs.withColumns({row: F.monotonically_increasing_id(), rep: F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text), F.lit(1)).alias("b"))}), "marked")
    slim = marked.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(row).alias("row"), F.col(f"{rep}.a").alias("a"), F.col(f"{rep}.b").alias("b"))
    first = slim.groupBy("a", "b").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    classes = stored(first.select("a", "b", F.col("best.row").alias("rep"), "best"), "texts")
    unique = marked.withColumnRenamed(row, own).join(classes.select(F.col("rep").alias(own)), own, "left_semi").select(F.col(own).alias("rep"), text.alias("text"))
    prints = sketches(unique, shingle)
    near = stored(components(links(prints, radius(similarity))).withColumnRenamed("node", "rep"), "near")
    found = components(confirmed(unique.join(near, "rep"), shingle, similarity)).withColumnRenamed("node", "rep")
    grouped = classes.join(found, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    winners = grouped.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return marked.join(winners, row, "left_semi").select(*[F.col(f"`{c}`") for c in names])

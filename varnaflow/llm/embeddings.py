"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors of a label are one class.  Each tree splits the space by random
directions at the median of a bounded sample; a vector within the spill margin of
a split goes down both sides, so close pairs are rarely parted, and several trees
make it rarer still.  Where the sample was too small for a leaf, the leaf is split
again, at medians of all its own classes, until it is small or splitting it no
longer saves comparisons (a family of near copies goes down both sides).  Classes are compared within (tree, leaf, label) only, cosines
are computed in double precision, and links are united by connected components.

A pair that meets in several leaves is counted in the first leaf the two share:
every row carries its vector's leaves, so that needs no set of pairs.  A leaf of
more than ``block`` classes is compared block against block, each pair of blocks a
task of its own; pairs never leave a task, only counts and spanning links do.  A
family of m vectors that are all linked still costs m * m / 2 cosines, as its link
counts demand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

COSINE = 0.98
TREES = 6
LEAF = 256
BLOCK = 1024
#: Leaves of more classes than this are split again, if that leaves less than this share of the comparisons.
LARGE, WORTH = 1024, 0.75
#: Rows that the first thresholds are fitted on, at most.
SAMPLE = 20_000
#: Margin at a split, in standard deviations of a linked pair's projected difference.
SPILL = 0.5


@dataclass
class Tree:
    """Splits in one list; a node's children follow it by number, a leaf is None."""

    nodes: list[tuple[np.ndarray, float, int, int] | None] = field(default_factory=list)

    def fit(self, x: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if depth > 0 and len(x) > 1:
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            along = x @ direction
            cut = float(np.median(along))
            self.nodes[me] = (direction, cut, self.fit(x[along <= cut], depth - 1, rng), self.fit(x[along > cut], depth - 1, rng))
        return me

    def leaves(self, x: np.ndarray, margin: float) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows of x in it), with spill."""
        out, todo = [], [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            node = self.nodes[n] if self.nodes else None
            if node is None:
                if len(rows):
                    out.append((n, rows))
                continue
            direction, cut, low, high = node
            along = x[rows] @ direction
            todo += [(low, rows[along <= cut + margin]), (high, rows[along >= cut - margin])]
        return out


@dataclass
class Forest:
    """Trees for each dimension that the sample has; other vectors are one leaf."""

    trees: dict[int, list[Tree]]
    margin: float

    @classmethod
    def fit(cls, sample: list[list[float]], rows: int, n_trees: int, leaf: int, cosine: float, spill: float, seed: int = 7) -> Forest:
        by: dict[int, list[list[float]]] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v)
        trees = {}
        depth = max(0, math.ceil(math.log2(max(1, rows / leaf))))
        for dim, vectors in by.items():
            x = np.array(vectors, np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            trees[dim] = [Tree() for _ in range(n_trees)]
            for k, tree in enumerate(trees[dim]):
                tree.fit(x, depth, np.random.default_rng([seed, dim, k]))
        return cls(trees, spill * math.sqrt(max(0.0, 2 - 2 * cosine)))

    def keys(self, vectors: list[list[float]]) -> list[list[int]]:
        """For each vector its (tree, leaf) keys, ascending."""
        out: list[list[int]] = [[] for _ in vectors]
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by.setdefault(len(v), []).append(i)
        for dim, places in by.items():
            x = np.array([vectors[i] for i in places], np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for k, tree in enumerate(self.trees.get(dim) or [Tree()]):
                for leaf, rows in tree.leaves(x, self.margin / math.sqrt(dim)):
                    for r in rows.tolist():
                        out[places[r]].append(k << 32 | leaf)
        return [sorted(x) for x in out]


def valid(label: str, vector: str):  # noqa: ANN201
    """Rows that may link: a label, and a vector of finite numbers that isn't zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """Counts and spanning links of one pair of blocks of a leaf."""
    key = table["key"][0].as_py()
    cross = table["low"][0].as_py() != table["high"][0].as_py()
    rep, count = table["rep"].to_numpy(), table["copies"].to_numpy()
    x = np.array(table["vector"].to_pylist(), np.float64)
    norm = np.linalg.norm(x, axis=1)
    side = table["block"].to_numpy() == table["low"][0].as_py()
    a = np.flatnonzero(side) if cross else np.arange(len(rep))
    b = np.flatnonzero(~side) if cross else a
    near = (x[a] @ x[b].T) / np.outer(norm[a], norm[b]) >= cosine
    if not cross:
        near &= rep[a][:, None] < rep[b][None, :]
    if not near.any():
        return _LINKS.empty_table()
    linked = np.zeros((len(rep), len(rep)), bool)
    linked[np.ix_(a, b)] = near
    linked |= linked.T
    # leaves before this one that two rows share: there they were counted
    earlier = [[k for k in keys if k < key] for keys in table["keys"].to_pylist()]
    number = {k: i for i, k in enumerate({k for ks in earlier for k in ks})}
    member = np.zeros((len(rep), len(number) or 1), np.float32)
    for i, ks in enumerate(earlier):
        member[i, [number[k] for k in ks]] = 1
    new = near & ((member[a] @ member[b].T) == 0)
    links = np.zeros(len(rep), np.int64)
    links[a] += new @ count[b]
    links[b] += new.T @ count[a]
    root = np.full(len(rep), -1)
    for i in range(len(rep)):
        if root[i] < 0 and linked[i].any():
            frontier = np.array([i])
            root[i] = i
            while len(frontier):
                frontier = np.flatnonzero(linked[frontier].any(axis=0) & (root < 0))
                root[frontier] = i
    some = np.flatnonzero(root >= 0)
    return pa.table([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], schema=_LINKS)


_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


_LEAF = ["key", "label", "size"]


def _along(vectors: pd.Series, keys: pd.Series) -> pd.Series:
    """Where each unit vector lies along its leaf's own random direction."""
    out = np.zeros(len(keys))
    for key, places in keys.groupby(keys).indices.items():
        for size, some in pd.Series(places).groupby([len(vectors.iloc[i]) for i in places]):
            x = np.array([vectors.iloc[i] for i in some], np.float64)
            direction = np.random.default_rng([int(key) % (1 << 64), size]).standard_normal(size)
            out[some] = x @ (direction / np.linalg.norm(direction)) / np.linalg.norm(x, axis=1)
    return pd.Series(out)


def split_again(members: DataFrame, margin: float, large: int = LARGE) -> DataFrame | None:
    """(rep, copies, label, vector, size, key): ``members`` with large leaves split; None if there are none.

    Each round deals with the leaves that are still large, at medians that Spark
    aggregates; no vectors come to the driver or to one task.
    """
    done, live, along = [], members, F.pandas_udf(_along, "double")
    while True:
        big = live.groupBy(*_LEAF).agg(F.count("*").alias("n")).where(F.col("n") > large)
        if big.isEmpty():
            return reduce(DataFrame.unionByName, [*done, live]) if done else None
        rest = live.join(big, _LEAF, "left_anti")
        placed = stored(live.join(big, _LEAF).withColumn("along", along("vector", "key")), "along")
        cuts = placed.groupBy(*_LEAF).agg(F.percentile_approx("along", 0.5, 1000).alias("cut"))
        reach = F.lit(margin) / F.sqrt("size")
        sided = placed.join(cuts, _LEAF).withColumns({"low": F.col("along") <= F.col("cut") + reach, "high": F.col("along") >= F.col("cut") - reach})
        sums = sided.groupBy(*_LEAF).agg(F.count_if("low").alias("lows"), F.count_if("high").alias("highs"))
        sided = stored(sided.join(sums, _LEAF), "sides")
        worth = F.col("lows") * F.col("lows") + F.col("highs") * F.col("highs") < WORTH * F.col("n") * F.col("n")
        columns = ["rep", "copies", "label", "vector", "size", "key"]
        done += [rest.select(*columns), sided.where(~worth).select(*columns)]
        sides = F.filter(F.array(F.when(F.col("low"), F.xxhash64("key", F.lit(0))), F.when(F.col("high"), F.xxhash64("key", F.lit(1)))), lambda k: k.isNotNull())
        live = stored(sided.where(worth).withColumn("key", F.explode(sides)).select(*columns), "split")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    n_trees: int = TREES,
    leaf: int = LEAF,
    block: int = BLOCK,
    sample: int = SAMPLE,
    spill: float = SPILL,
    large: int = LARGE,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors without a label, null, zero or with null or non-finite components link
    with nothing and are their own component.  Rows with a null vec_id link like
    others but name no component.  Vectors of different lengths never link.
    Repeated rows are vectors of their own.  An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.withColumn("valid", valid("label", "vector"))
    some = rows.where("valid").groupBy("label", "vector").agg(F.min("vec_id").alias("doc"), F.count("*").alias("copies"))
    spare = F.xxhash64("label", "vector").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    classes = stored(some.withColumn("rep", F.coalesce("doc", spare)), "classes")

    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chosen = [r[0] for r in classes.select("vector").orderBy(F.xxhash64("vector")).limit(sample).collect()]
    forest = classes.sparkSession.sparkContext.broadcast(Forest.fit(chosen, largest, n_trees, leaf, cosine, spill))

    @F.pandas_udf("array<long>")
    def keys(series):  # noqa: ANN001, ANN202
        return pd.Series(forest.value.keys([list(v) for v in series]), dtype=object)

    placed = classes.select("rep", "copies", "label", "vector", keys("vector").alias("keys"))
    placed = stored(placed.withColumn("key", F.explode("keys")).withColumn("size", F.size("vector")), "leaves")
    again = split_again(placed.drop("keys"), spill * math.sqrt(max(0.0, 2 - 2 * cosine)), large)
    if again is not None:
        again = stored(again, "leaves")
        placed = again.join(again.groupBy("rep").agg(F.array_sort(F.collect_set("key")).alias("keys")), "rep")
    sizes = placed.groupBy("key", "label", "size").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    member = placed.join(sizes.drop("n"), ["key", "label", "size"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    pairs = member.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    found = stored(pairs.groupBy("key", "label", "size", "low", "high").applyInArrow(lambda t: _compare(t, cosine), "rep long, links long, root long"), "links")

    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    united = components(found, "rep", "root").withColumnRenamed("node", "rep")
    named = classes.join(counted, "rep", "left").join(united, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    roots = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    answer = named.join(roots, "root").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.where("valid").join(answer, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

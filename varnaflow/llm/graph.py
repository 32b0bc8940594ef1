"""Connected components of large graphs, by alternating large-star and small-star steps.

Nodes are longs; a component is named by its smallest node.  Every step is an
aggregation of minima, combined before the shuffle, and an equi-join of the edges
with them.  Both sides of the join are shuffled for the join alone, so that Spark
can deal the edges of a node with very many neighbours out over several tasks.
Each step's edges are written to the shared folder, which cuts the lineage: plans
stay small, and so does what the driver keeps of them.  Steps end as soon as the
edges are stars, which links that come as stars are from the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v.  Connects neighbours of each node to the smallest of them."""
    around = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v") if large else edges
    # not the aggregation's own key: its partitioning would be reused and could not be split
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("w"), (F.least("u", "m") if large else F.col("m")).alias("m"))
    met = (around.where("v > u") if large else around).join(least, F.col("u") == F.col("w"))
    if large:  # an edge gives one edge, so repeated ones may stay for the small star
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    new = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return new.where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down, to a node that has none: then that is its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.max((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)).alias("more")).first()["more"]


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    Self-loops, repeated edges and edges with a null end are ignored; nodes
    without edges are not returned, and an empty table gives no rows.
    """
    ends = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b"))
    current = ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = stored(current, "edges")
    while not _stars(current):
        current = stored(_star(stored(_star(current, True), "edges"), False), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

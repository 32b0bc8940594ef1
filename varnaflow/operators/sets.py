"""Set operations on corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merged_distinct(frames: list[DataFrame]) -> DataFrame:
    return stacked(frames).distinct()


def first_of_key(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order, combined before the shuffle."""
    rest = [c for c in frame.columns if c != key]
    first = frame.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    return first.select(key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")

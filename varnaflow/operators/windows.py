"""Sequence logic: frames, first maxima, batches and early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .scans import prefix_scan


def frames(tokens: Column, width: int = 3) -> Column:
    """All runs of ``width`` neighbouring elements; none of a shorter array."""

    def cut(ts: Column) -> Column:
        n = F.size(ts)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.slice(ts, i, F.lit(width)))
        return F.when(n >= width, runs).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, cut)


def without_runs(values: Column) -> Column:
    """Neighbouring equal elements once."""
    return let(values, lambda vs: F.filter(vs, lambda x, i: (i == 0) | (x != F.get(vs, i - 1))))


def first_best(frame: DataFrame, score: str, order: str, *keys: str) -> DataFrame:
    """The row of highest score of each key; the first in order of equals.  One combined row travels for each key and task."""
    rest = [c for c in frame.columns if c not in keys]
    best = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(order))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def batches(frame: DataFrame, n: str = "n", size: int = 10, start: int = 0) -> DataFrame:
    """Numbered rows with their batch and absolute id."""
    return frame.withColumns({"batch": F.floor((F.col(n) - 1) / size), "id": F.col(n) + start})


def early_stop(curve: DataFrame, patience: int = 3, value: str = "val_loss", order: str = "epoch", *keys: str) -> DataFrame:
    """Epochs with the best so far, epochs since it improved, and whether training had stopped before.

    Without keys the whole table is one curve; three scans, none of them in one task.
    """
    rows = prefix_scan(curve, [order], list(keys), exclusive=True, _least=("min", F.col(value)))
    rows = rows.withColumn("improved", F.coalesce(F.col(value) < F.col("_least"), F.lit(True))).withColumn("best", F.least("_least", value)).drop("_least")
    rows = prefix_scan(rows, [order], list(keys), _better=("max", F.when(F.col("improved"), F.col(order))))
    rows = rows.withColumn("waited", F.col(order) - F.col("_better")).drop("_better")
    rows = prefix_scan(rows, [order], list(keys), exclusive=True, _late=("max", F.col("waited")))
    return rows.withColumn("stopped", F.coalesce(F.col("_late") > patience, F.lit(False))).drop("_late")

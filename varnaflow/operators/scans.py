"""Running aggregates over one global order, without one task that reads it all.

A scan takes three passes: rows are dealt out by ranges of the order and stored;
each range gives one partial state; the states of the ranges before it (one row a
range) enter each range as a first row, and the second pass runs within ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_path

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def kept(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read again: later passes see the same rows in the same ranges."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def prefix_scan(frame: DataFrame, order: list[str | Column], keys: list[str] = (), exclusive: bool = False, **scans: tuple[str, Column]) -> DataFrame:
    """``frame`` with a running aggregate for each of ``scans``: name=("sum" | "min" | "max", value).

    The order runs within each key, nulls first; without keys it is one sequence.  Rows of
    equal order follow one another in any way, fixed for all scans of a call.
    ``exclusive`` leaves the row itself out, and is null where nothing comes before.
    Nulls don't count.  A range is cut wherever its rows are too many, inside a key
    and inside equal orders too, so no key and no tie gathers in one task.
    """
    columns = [F.col(f"`{c}`") for c in frame.columns]
    names = [f"_scan_{i}" for i in range(len(scans))]
    values = frame.select(*columns, *[value.alias(n) for n, (_, value) in zip(names, scans.values(), strict=True)], F.monotonically_increasing_id().alias("_scan_tie"))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    group = [F.col(f"`{k}`") for k in keys]
    ordered = values.select("*", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]).alias("_scan_order"))
    ranges = kept(ordered.repartitionByRange(*group, "_scan_order", "_scan_tie").withColumn("_scan_part", F.spark_partition_id()), "scan")
    kinds = [_AGGREGATE[kind] for kind, _ in scans.values()]
    states = ranges.groupBy(*group, "_scan_part").agg(*[f(n).alias(n) for f, n in zip(kinds, names, strict=True)])
    earlier = Window.partitionBy(*group).orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = states.select(*group, "_scan_part", *[f(n).over(earlier).alias(n) for f, n in zip(kinds, names, strict=True)], F.lit(True).alias("_scan_carried"))
    rows = ranges.withColumn("_scan_carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    within = Window.partitionBy(*group, "_scan_part").orderBy(F.col("_scan_carried").desc(), "_scan_order", "_scan_tie")
    within = within.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    scanned = rows.select(*columns, "_scan_carried", *[f(n).over(within).alias(name) for f, n, name in zip(kinds, names, scans, strict=True)])
    return scanned.where(~F.col("_scan_carried")).drop("_scan_carried")


def numbered(frame: DataFrame, *order: str | Column, keys: list[str] = (), name: str = "n") -> DataFrame:
    """``frame`` with its row number from 1 in one global order, or within each key."""
    return prefix_scan(frame, list(order), keys, **{name: ("sum", F.lit(1).cast("long"))})

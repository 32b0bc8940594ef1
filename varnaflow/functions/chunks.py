"""Greedy chunks of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text, words


def chunk_text(c: Column, most: int = 125) -> Column:
    """array<string> of at most ``most`` characters each; a short text is one chunk as it is.

    Words are packed while they fit; a longer word is cut hard and the next chunk
    starts afresh.
    """
    t = text(c)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(state: Column, w: Column) -> Column:
        now = state["now"]
        longer = F.when(now == "", w).otherwise(F.concat(now, F.lit(" "), w))
        done = F.when(now == "", state["done"]).otherwise(F.concat(state["done"], F.array(now)))
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1)), F.lit(most)), lambda i: F.substring(w, i, F.lit(most)))
        return (
            F.when(F.length(longer) <= most, F.struct(state["done"].alias("done"), longer.alias("now")))
            .when(F.length(w) > most, F.struct(F.concat(done, cut).alias("done"), F.lit("").alias("now")))
            .otherwise(F.struct(done.alias("done"), w.alias("now")))
        )

    packed = F.aggregate(words(t), start, add, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))
    return F.when(F.length(t) <= most, F.array(t)).otherwise(packed)

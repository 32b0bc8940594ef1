"""Lookups and alignments as joins.

Dictionary sides are joined without a forced broadcast: Spark broadcasts them while
they are below its size limit and shuffles beyond it.  Re-grouping by row id sends
one partly combined row for each sentence and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def tokens(frame: DataFrame, column: str, *ids: str) -> DataFrame:
    """(ids, pos, token): one row for each word."""
    return frame.select(*ids, F.posexplode(words(F.col(column))).alias("pos", "token"))


def sentences(rows: DataFrame, *ids: str, token: str = "token", joined: str = "sentence") -> DataFrame:
    """The tokens of each id joined in order."""
    gathered = rows.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(token).alias("t")))).alias("_t"))
    return gathered.select(*ids, F.array_join(F.transform("_t", lambda x: x["t"]), " ").alias(joined))


def lookup(rows: DataFrame, key: Column, table: DataFrame, variant: str = "variant", base: str = "base") -> DataFrame:
    """``rows`` with ``base``: the dictionary form of ``key``, or null."""
    return rows.join(table.select(F.col(variant).alias("_variant"), F.col(base).alias("base")), key == F.col("_variant"), "left").drop("_variant")


def membership(rows: DataFrame, key: Column, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """``rows`` with ``known``: whether ``key`` is a word of the vocabulary."""
    known = vocabulary.select(F.col(word).alias("_word")).distinct().withColumn("_in", F.lit(True))
    return rows.join(known, key == F.col("_word"), "left").withColumn("known", F.coalesce("_in", F.lit(False))).drop("_word", "_in")


def align_lines(reference: DataFrame, hypothesis: DataFrame, n: str = "n") -> DataFrame:
    """(keys, n, ref, hyp) where both have a line of this number: the shorter side ends it."""
    return hypothesis.withColumnRenamed("value", "hyp").join(reference.select(n, F.col("value").alias("ref")), n)


def zip_arrays(a: Column, b: Column) -> Column:
    """Pairs up to the shorter array's end."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("left"), F.slice(b, F.lit(1), n).alias("right"))


def phonetic_blocks(words_: DataFrame, code: str = "code", word: str = "word") -> DataFrame:
    """(code, words): the different words of each code, two at least."""
    return words_.groupBy(code).agg(F.array_sort(F.collect_set(word)).alias("words")).where(F.size("words") > 1)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(code, head, other): each word of a block with the block's first, as many rows as words."""
    return blocks.select("code", F.col("words")[0].alias("head"), F.explode(F.slice("words", F.lit(2), F.size("words"))).alias("other"))


def first_pairs(coded: DataFrame, code: str = "code", word: str = "word") -> DataFrame:
    """``block_pairs`` of the different words of each code, without an array of a block: words follow in order behind the first."""
    behind = Window.partitionBy(code).orderBy(word).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    headed = coded.select(code, F.first(word).over(behind).alias("head"), F.col(word).alias("other"))
    return headed.where(F.col("head") != F.col("other"))


def candidate_places(sources: DataFrame, targets: DataFrame, *ids: str) -> DataFrame:
    """Source places with the target places of the same sentence inside the searched band.

    ``sources`` has (ids, pos, n_in), ``targets`` (ids, pos, n_out); joined on the ids
    with the band as a residual predicate, so a sentence makes a few rows a word.
    """
    s, t = sources.alias("s"), targets.alias("t")
    same = reduce(lambda x, y: x & y, [F.col(f"s.{i}") == F.col(f"t.{i}") for i in ids])
    surplus = F.col("s.n_in") - F.col("t.n_out")
    band = F.col("t.pos").between(F.greatest(F.lit(0), F.col("s.pos") - 2 * surplus - 1), F.least(F.col("t.n_out") - 1, F.col("s.pos") + 1))
    return s.join(t, same & band).select(*[F.col(f"s.{i}").alias(i) for i in ids], F.col("s.pos").alias("source_pos"), F.col("t.pos").alias("target_pos"))


def with_configs(frame: DataFrame, configs: list[tuple[str, ...]], *names: str) -> DataFrame:
    """Each row once for each configuration; the list is part of the plan."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, config, strict=True)]) for config in configs])
    return frame.withColumn("_config", F.explode(rows)).select("*", *[F.col(f"_config.{n}").alias(n) for n in names]).drop("_config")


def overlay_edits(rows: DataFrame, edits: DataFrame, key: str = "row", order: str = "seq", columns: tuple[str, ...] = ("romanized", "devanagari")) -> DataFrame:
    """Rows with the newest edit of each applied; ``edits`` has ``new_<column>``."""
    newest = edits.groupBy(key).agg(F.max_by(F.struct(*[f"new_{c}" for c in columns]), order).alias("_new"))
    joined = rows.join(newest, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new.new_{c}"), F.col(c)) for c in columns}).drop("_new")


def neighbours(rows: DataFrame, *ids: str) -> DataFrame:
    """Token rows with the tokens before and after."""
    w = Window.partitionBy(*ids).orderBy("pos")
    return rows.withColumns({"before": F.lag("token").over(w), "after": F.lead("token").over(w)})

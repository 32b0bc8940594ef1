"""The romanized-corpus plan: clean, measure English, filter, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import Test
from ..functions.text import let, output_name, plain_lower, ratio_words, remove_emojis, repair_separators
from ..operators.aggregates import corpus_statistics
from ..operators.filters import romanized_only
from ..operators.joins import membership


def analysed(lines: DataFrame, english: Test, column: str = "value") -> DataFrame:
    """``lines`` with clean, english_ratio, english_words, total_words, genuine_words and what cleaning changed.  Row-local."""


    def counted(x: Column) -> Column:
        ratio = F.when(x["n"] == 0, 0.0).otherwise(x["k"] / x["n"])
        return F.struct(
            x["clean"].alias("clean"),
            (x["e"] != F.col(column)).alias("emoji_fixed"),
            (x["clean"] != x["e"]).alias("separators_fixed"),
            (x["clean"] == "").alias("blank"),
            x["k"].alias("english_words"),
            x["n"].alias("total_words"),
            (x["n"] - x["k"]).alias("genuine_words"),
            ratio.alias("english_ratio"),
        )

    def worded(x: Column) -> Column:
        numbers = lambda ws: F.struct(x["e"].alias("e"), x["clean"].alias("clean"), F.size(F.filter(ws, english)).cast("long").alias("k"), F.size(ws).cast("long").alias("n"))
        return let(ratio_words(x["clean"]), numbers)

    cleaned = let(remove_emojis(F.col(column)), lambda e: F.struct(e.alias("e"), repair_separators(e).alias("clean")))
    return lines.withColumn("_a", let(let(cleaned, worded), counted)).select(*lines.columns, "_a.*")


def analysed_by_join(lines: DataFrame, vocabulary: DataFrame, column: str, *ids: str) -> DataFrame:
    """(ids, english_ratio, english_words, total_words, genuine_words) for vocabularies too large for a plan."""
    rows = lines.select(*ids, F.explode_outer(ratio_words(repair_separators(remove_emojis(F.col(column))))).alias("w"))
    flagged = membership(rows, F.col("w"), vocabulary)
    counted = flagged.groupBy(*ids).agg(F.count_if("known").alias("english_words"), F.count("w").alias("total_words"))
    return counted.withColumns({"genuine_words": F.col("total_words") - F.col("english_words"), "english_ratio": F.coalesce(F.try_divide("english_words", "total_words"), F.lit(0.0))})


def romanized_corpus(lines: DataFrame, english: Test, column: str = "value", threshold: float = 0.4, least: int = 4, keep_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept lines with ``sentence``, one row of statistics)."""
    rows = analysed(lines, english, column)
    kept = romanized_only(rows.where(~F.col("blank")), threshold, least)
    sentence = F.col("clean") if keep_case else plain_lower(F.col("clean"))
    return kept.withColumn("sentence", sentence), corpus_statistics(rows, threshold=threshold, least=least)


def per_file(lines: DataFrame, english: Test, threshold: float = 0.4, least: int = 4) -> DataFrame:
    """(file, output, sentences, kept): the filter over many files at once."""
    rows = analysed(lines, english)
    kept = (F.col("english_ratio") < threshold) & (F.col("genuine_words") >= least) & ~F.col("blank")
    return rows.groupBy("file").agg(F.count("*").alias("sentences"), F.count_if(kept).alias("kept")).withColumn("output", output_name(F.col("file")))

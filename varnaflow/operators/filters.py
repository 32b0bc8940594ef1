"""Predicates and filters over corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import similarity
from ..functions.repair import MARKERS
from ..functions.text import clean_token, contains_devanagari, is_digits, text

#: Pairs in which a word was taken for another: romanized word, wrong Devanagari (fixed values).
KNOWN_MIX_UPS = {"paryawaran": "वातावरण"}


def without_devanagari(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(~contains_devanagari(F.col(column)))


def romanized_only(analysed: DataFrame, threshold: float = 0.4, least: int = 4) -> DataFrame:
    """Sentences with an English ratio below ``threshold`` and ``least`` other words at least."""
    return analysed.where((F.col("english_ratio") < threshold) & (F.col("genuine_words") >= least))


def removal_reason(threshold: float = 0.4, least: int = 4) -> Column:
    """``high``, ``low``, ``both`` or null for a kept sentence."""
    high, low = F.col("english_ratio") >= threshold, F.col("genuine_words") < least
    return F.when(high & low, "both").when(high, "high").when(low, "low")


def not_blank(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(text(column) != "")


def longer_than(frame: DataFrame, column: str, n: int = 1) -> DataFrame:
    return frame.where(F.length(column) > n)


def not_in(frame: DataFrame, column: str, vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose lower-cased value isn't in the vocabulary; Spark broadcasts it only below its own size limit."""
    return frame.join(vocabulary.select(F.col(word).alias("_known")).distinct(), F.lower(column) == F.col("_known"), "left_anti")


def length_fits(source: Column, target: Column, low: float = 0.5, high: float = 2.25) -> Column:
    r = F.greatest(F.length(clean_token(target)), F.lit(1)) / F.greatest(F.length(clean_token(source)), F.lit(1))
    return r.between(low, high)


def is_marker(c: Column) -> Column:
    return F.lower(clean_token(c)).isin(sorted(MARKERS))


def is_roman_number(c: Column) -> Column:
    return is_digits(text(c))


def has_devanagari_digit(c: Column) -> Column:
    return text(c).rlike("[\\u0966-\\u096F]")


def pair_issues(romanized: Column, devanagari: Column) -> Column:
    """array<string> of what looks wrong in a pair: known mix-ups and odd length ratios."""
    r, d = text(romanized), text(devanagari)
    rate = F.when(d == "", 0.0).otherwise(F.length(r) / F.length(d))
    found = [F.when(F.lower(r).contains(word) & d.contains(wrong), F.lit(f"mix-up:{word}")) for word, wrong in KNOWN_MIX_UPS.items()]
    found.append(F.when((rate < 0.3) | (rate > 3), F.concat(F.lit("length-ratio:"), F.format_number(rate, 2))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def unlike(frame: DataFrame, a: str, b: str, below: float = 0.3) -> DataFrame:
    """Rows whose two texts have a matching ratio below the limit."""
    return frame.withColumn("ratio", similarity(F.col(a), F.col(b))).where(F.col("ratio") < below)


def scored_enough(frame: DataFrame, column: str = "score", least: float = 0.30) -> DataFrame:
    return frame.where(F.col(column) >= least)

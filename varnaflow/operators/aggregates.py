"""Aggregations over corpora, metrics and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import cer as _cer
from ..functions.metrics import char_bleu, char_errors, word_errors, words_in_place
from ..functions.metrics import wer as _wer
from ..functions.text import text, words
from .scans import prefix_scan


def distinct_words(lines: DataFrame, column: Column) -> DataFrame:
    """(word, n): different words with their count, combined before the shuffle."""
    return lines.select(F.explode(words(column)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def distinct_lower(lines: DataFrame, tokens: Column) -> DataFrame:
    """(word, n): different words of an array in lower case, which is asked of each different spelling once.

    ``word`` reads ``n``, which is always positive: filters and joins of the different
    words would otherwise be moved below the aggregation, to every word of every text.
    """
    spelled = lines.select(F.explode(tokens).alias("_w")).groupBy("_w").agg(F.count("*").alias("_n"))
    counted = spelled.groupBy(F.lower("_w").alias("_word")).agg(F.sum("_n").alias("n"))
    return counted.select(F.when(F.col("n") > 0, F.col("_word")).alias("word"), "n")


def line_counts(lines: DataFrame, file: str = "file") -> DataFrame:
    """(file, n): lines of each file, and of all with a null file."""
    return lines.rollup(file).agg(F.count("*").alias("n"))


def length_profile(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row: word and character lengths, and the shortest, median and longest line by length."""
    sized = lines.select(F.col(column).alias("v"), F.size(words(F.col(column))).alias("w"), F.length(column).alias("c"))
    stats = sized.agg(*[f(x).alias(f"{name}_{what}") for x, what in (("w", "words"), ("c", "chars")) for f, name in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))], F.min_by("v", F.struct("c", "v")).alias("shortest"), F.max_by("v", F.struct("c", "v")).alias("longest"), F.count("*").alias("n"))
    # the median line without a global sort: the length where half the lines are reached, then a rank within it
    by_length = sized.groupBy("c").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = by_length.withColumn("before", before).crossJoin(stats.select(F.floor(F.col("n") / 2).alias("half"))).where("before <= half and half < before + m").select("c", (F.col("half") - F.col("before")).alias("rank"))
    there = sized.join(half, "c").withColumn("at", F.row_number().over(Window.partitionBy("c").orderBy("v")) - 1).where("at = rank").select(F.col("v").alias("median"))
    return stats.join(there.limit(1), F.lit(True), "left")


def corpus_statistics(analysed: DataFrame, original: Column | None = None, threshold: float = 0.4, least: int = 4) -> DataFrame:
    """One row of the romanized filter's statistics; zeros where nothing is kept.

    ``analysed`` has english_ratio, genuine_words, emoji_fixed, separators_fixed and
    blank (whether nothing was left after cleaning).
    """
    kept = (F.col("english_ratio") < threshold) & (F.col("genuine_words") >= least) & ~F.col("blank")
    high, low, clean = F.col("english_ratio") >= threshold, F.col("genuine_words") < least, ~F.col("blank")
    count = lambda c: F.count_if(c)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ratio, genuine = F.when(kept, F.col("english_ratio") * 100), F.when(kept, F.col("genuine_words"))
    return analysed.agg(
        F.count("*").alias("original_sentences"),
        count(clean).alias("cleaned_sentences"),
        count(kept).alias("romanized_sentences"),
        (count(clean) - count(kept)).alias("removed_sentences"),
        count(clean & high & ~low).alias("removed_high_english"),
        count(clean & low & ~high).alias("removed_low_genuine"),
        count(clean & high & low).alias("removed_both_issues"),
        zero(F.try_divide(count(kept), count(clean)) * 100).alias("success_rate"),
        zero(F.avg(ratio)).alias("avg_english_ratio"),
        zero(F.max(ratio)).alias("max_english_ratio"),
        zero(F.min(ratio)).alias("min_english_ratio"),
        zero(F.avg(genuine)).alias("avg_genuine_words"),
        F.coalesce(F.min(genuine), F.lit(0)).cast("long").alias("min_genuine_words"),
        F.coalesce(F.max(genuine), F.lit(0)).cast("long").alias("max_genuine_words"),
        count("emoji_fixed").alias("emoji_fixes"),
        count("separators_fixed").alias("separator_fixes"),
    )


def settled(frame: DataFrame, *names: str) -> DataFrame:
    """``frame`` with the given columns computed before any expression reads them.

    Spark writes a column that is read once into what reads it, and doesn't find a Python
    function again in which a lambda of a lambda was written so; what ``inline`` gives stays as it is.
    """
    rest = [F.col(f"`{c}`") for c in frame.columns if c not in names]
    return frame.select(*rest, F.inline(F.array(F.struct(*names)))).select(*[F.col(f"`{c}`") for c in frame.columns])


def joined_scores(pairs: DataFrame, *keys: str) -> DataFrame:
    """CER and WER of all lines of a key joined by spaces, as one text: for evaluation sets of some thousand lines."""
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(c).alias("v")))), lambda x: x["v"]), " ")
    joined = pairs.groupBy(*keys).agg(whole("ref").alias("ref"), whole("hyp").alias("hyp"))
    return joined.select(*keys, _cer(F.col("hyp"), F.col("ref")).alias("cer"), _wer(F.col("hyp"), F.col("ref")).alias("wer"))


def micro_scores(pairs: DataFrame, *keys: str, guard: bool = True) -> DataFrame:
    """Sums of errors over sums of lengths; ``guard`` counts an empty truth as one."""
    p, t = F.col("hyp"), F.col("ref")
    # one row of whole numbers a pair: each distance is computed once
    each = settled(pairs, "hyp", "ref").select(*keys, char_errors(p, t).alias("_c"), word_errors(p, t).alias("_w"), words_in_place(p, t).alias("_same"), F.length(text(t)).alias("_n"), F.size(words(t)).alias("_m"))
    n, m = (F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.col("_m"), F.lit(1))) if guard else (F.col("_n"), F.col("_m"))
    return each.groupBy(*keys).agg(
        F.try_divide(F.sum("_c"), F.sum(n)).alias("cer"),
        F.try_divide(F.sum("_w"), F.sum(m)).alias("wer"),
        F.try_divide(F.sum("_same"), F.sum("_m")).alias("word_accuracy"),
        F.avg("_c").alias("mean_edit_distance"),
    )


def mean_bleu(pairs: DataFrame, *keys: str, method: int = 4) -> DataFrame:
    return settled(pairs, "hyp", "ref").groupBy(*keys).agg(F.coalesce(F.avg(char_bleu(F.col("hyp"), F.col("ref"), method)), F.lit(0.0)).alias("bleu"))


def best_by_metric(metrics: DataFrame, name: str, order: str, *keys: str) -> DataFrame:
    """Who is best in each metric (least cer and wer, most bleu); nulls don't count, ties go to the least ``order``."""
    who = lambda c, sign: F.min_by(name, F.when(F.col(c).isNotNull(), F.struct((F.col(c) * sign).alias("s"), F.col(order)))).alias(f"best_{c}")
    return metrics.groupBy(*keys).agg(who("cer", 1), who("wer", 1), who("bleu", -1))


def best_config_then_model(metrics: DataFrame, order: str = "ord") -> DataFrame:
    """Per model its configuration of least CER with the model's best values, ranked by CER, nulls last."""
    per_model = metrics.groupBy("model").agg(
        F.min_by("config", F.when(F.col("cer").isNotNull(), F.struct("cer", order))).alias("config"),
        F.min("cer").alias("cer"),
        F.min("wer").alias("wer"),
        F.max("bleu").alias("bleu"),
    )
    return per_model.orderBy(F.col("cer").asc_nulls_last(), "model")


def edit_summary(edits: DataFrame, last: int = 5) -> DataFrame:
    """One row: rows edited, edits, and the newest edits' rows, newest first."""
    counts = edits.agg(F.countDistinct("row").alias("rows_edited"), F.count("*").alias("edits"))
    newest = edits.orderBy(F.col("seq").desc()).limit(last).agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("seq", "row"))), lambda x: x["row"])).alias("newest"))
    return counts.join(newest, F.lit(True))


def running_mean(frame: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """``frame`` with the mean so far, in order within each key; without keys of one sequence over the whole table."""
    scanned = prefix_scan(frame, [order], list(keys), _sum=("sum", F.col(value)), _n=("sum", F.col(value).isNotNull().cast("long")))
    return scanned.withColumn("mean_so_far", F.try_divide("_sum", "_n")).drop("_sum", "_n")


def base_words(lookup: DataFrame) -> DataFrame:
    return lookup.agg(F.countDistinct("base").alias("bases"), F.count("*").alias("variants"))

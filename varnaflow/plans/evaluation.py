"""Scoring outputs against references and ranking models and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import joined_scores, mean_bleu, micro_scores
from ..operators.joins import align_lines


def evaluate(reference: DataFrame, outputs: DataFrame, *keys: str, joined: bool = True, bleu_method: int = 4) -> DataFrame:
    """(keys, cer, wer, bleu): ``reference`` (n, value), ``outputs`` (keys, n, value).

    ``joined`` scores each key's lines as one text, as small evaluation sets are
    reported; otherwise errors and lengths are summed over lines.
    """
    pairs = align_lines(reference, outputs)
    errors = joined_scores(pairs, *keys) if joined else micro_scores(pairs, *keys).select(*keys, "cer", "wer")
    return errors.join(mean_bleu(pairs, *keys, method=bleu_method), list(keys))


def report_lines(metrics: DataFrame) -> DataFrame:
    """(n, value): configurations by CER, nulls last, one line each."""
    show = lambda c: F.coalesce(F.format_number(c, 4), F.lit("-"))
    return metrics.orderBy(F.col("cer").asc_nulls_last(), "config").select(F.concat_ws(" ", "config", show("cer"), show("wer"), show("bleu")).alias("value"))

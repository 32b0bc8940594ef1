"""Normalizing sentences with rules and a variant dictionary, with a change log; ablation arms; serving."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import chunk_text
from ..functions.normalize import Test, changes_of, rule_based, ruled_words, vocabulary_test, word_parts
from ..functions.repair import repair
from ..functions.text import text, words
from ..functions.translit import transliterate
from ..operators.joins import lookup, with_configs

ARMS = ("combined", "rule_based", "pvd_only", "raw")


def _regrouped(rows: DataFrame, ids: tuple[str, ...], word: Column, changes: Column | None = None) -> DataFrame:
    """Words joined in order again; a sentence without words is empty."""
    fields = [F.col("pos"), F.when(F.col("pos").isNotNull(), word).alias("w")] + ([changes.alias("c")] if changes is not None else [])
    gathered = rows.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("_w"))
    out = [F.array_join(F.transform("_w", lambda x: x["w"]), " ").alias("normalized")]
    if changes is not None:
        out.append(F.flatten(F.transform("_w", lambda x: x["c"])).alias("changes"))
    return gathered.select(*ids, *out)


def normalize_with_changes(frame: DataFrame, column: str, english: Test, pvd: DataFrame, *ids: str) -> DataFrame:
    """(ids, normalized, changes): rules, then the dictionary (variant, base); one change row a rule that fired.

    A dictionary hit is a change even where the base equals the word.
    """
    parts = frame.select(*ids, F.posexplode_outer(ruled_words(F.col(column), english)).alias("pos", "p"))
    found = lookup(parts, F.col("p.w"), pvd)
    p = F.col("p")
    changes = F.when(F.col("pos").isNull(), F.array().cast("array<struct<original:string,replaced:string,rule:string>>")).otherwise(changes_of(p, F.col("base")))
    return _regrouped(found, ids, F.concat(p["prefix"], F.coalesce("base", p["w"]), p["suffix"]), changes)


def pvd_only(frame: DataFrame, column: str, pvd: DataFrame, *ids: str) -> DataFrame:
    """(ids, normalized): only the dictionary, on words as they are written; its keys are lower-case."""
    parts = frame.select(*ids, F.posexplode_outer(F.transform(words(F.col(column)), word_parts)).alias("pos", "p"))
    found = lookup(parts, F.col("p.core"), pvd)
    return _regrouped(found, ids, F.concat(F.col("p.prefix"), F.coalesce("base", F.col("p.core")), F.col("p.suffix")))


def arms(frame: DataFrame, column: str, english: Test, pvd: DataFrame, *ids: str) -> DataFrame:
    """(ids, config, normalized): each row under each preprocessing arm."""
    made = {
        "combined": normalize_with_changes(frame, column, english, pvd, *ids).select(*ids, "normalized"),
        "rule_based": frame.select(*ids, rule_based(F.col(column), english).alias("normalized")),
        "pvd_only": pvd_only(frame, column, pvd, *ids),
        "raw": frame.select(*ids, text(column).alias("normalized")),
    }
    out = None
    for name in ARMS:
        part = made[name].withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def _output(column: str, model: Callable[[Column], Column] | None, most: int | None) -> Column:
    use = model or transliterate
    chunks = chunk_text(F.col(column), most) if most else F.array(text(column))
    return F.when(text(column) == "", "").otherwise(F.array_join(F.transform(chunks, use), " "))


def chunked_output(frame: DataFrame, column: str, model: Callable[[Column], Column] | None, most: int | None, *ids: str) -> DataFrame:
    """(ids, output): chunks through the model, joined again by one space; without a limit the text is one chunk."""
    return frame.select(*ids, _output(column, model, most).alias("output"))


def ablation(frame: DataFrame, column: str, english: Test, pvd: DataFrame, models: list[tuple[str, int]], model: Callable[[Column], Column] | None = None, *ids: str) -> DataFrame:
    """(ids, config, model, output) for every arm and (name, chunk length or 0) of ``models``; the arms are made once for all models."""
    rows = with_configs(arms(frame, column, english, pvd, *ids), [(name, most) for name, most in models], "model", "most")
    outputs = F.coalesce(*[F.when(F.col("most") == most, _output("normalized", model, most or None)) for most in sorted({m for _, m in models})])
    return rows.select(*ids, "config", "model", outputs.alias("output"))


def serve(frame: DataFrame, column: str, english: Iterable[str], pvd: DataFrame, *ids: str, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """(ids, normalized, changes, transliterated, text, replacements): the whole path of one input; blank input gives blanks."""
    known = list(english)
    ready = normalize_with_changes(frame, column, vocabulary_test(known), pvd, *ids)
    spoken = ready.withColumn("transliterated", (model or transliterate)(F.col("normalized")))
    return repair(spoken, "normalized", "transliterated", known).select(*ids, "normalized", "changes", "transliterated", "text", "replacements")

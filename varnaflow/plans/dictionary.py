"""Building variant dictionaries, Devanagari word lists and augmented corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phonetic import primary_code
from ..functions.text import corpus_words, devanagari_runs, text, words
from ..operators.aggregates import distinct_lower
from ..operators.filters import not_in
from ..operators.scans import kept, numbered


def coded_words(lines: DataFrame, column: str, vocabulary: DataFrame, pattern: str | None = None) -> DataFrame:
    """(word, n, code): different words outside the vocabulary, with their phonetic code.

    Words are made different before they are coded.
    """
    found = distinct_lower(lines, corpus_words(F.col(column)))
    if pattern:
        found = found.where(F.col("word").rlike(pattern))
    # Only words with a letter have a code; asked of the word, so that codes are computed once.
    lettered = (F.length("word") == 2) | F.translate(F.lower("word"), "āīūṁṃñṙ", "aiummnr").rlike("[a-z]")
    return not_in(found, "word", vocabulary).where(lettered).withColumn("code", primary_code(F.col("word")))


def _base_word() -> Column:
    """The most frequent word, of equals the least."""
    return F.min_by("word", F.struct((-F.col("n")).alias("s"), "word")).alias("base_word")


def variant_groups(lines: DataFrame, column: str, vocabulary: DataFrame, pattern: str | None = None, least: int = 2) -> DataFrame:
    """(code, base_word, variants, n): unknown words by phonetic code, a row for each; for codes of any size see ``variant_postings``."""
    coded = coded_words(lines, column, vocabulary, pattern)
    groups = coded.groupBy("code").agg(_base_word(), F.array_sort(F.collect_set("word")).alias("variants"), F.count("*").alias("n"))
    return groups.where(F.col("n") >= least)


def postings_of(coded: DataFrame, least: int = 2, chunk: int = 1000) -> DataFrame:
    """(code, chunk, base_word, n, variants): the words of each code in order, at most ``chunk`` a row.

    ``coded`` has word, n and code.  Words are numbered within their code by a scan
    that cuts a code over tasks, and no row or task holds a code whole; base words and
    sizes are partial aggregates.
    """
    stored = kept(coded.select("word", "n", "code"), "coded")
    bases = stored.groupBy("code").agg(_base_word(), F.count("*").alias("total")).where(F.col("total") >= least)
    placed = numbered(stored.select("word", "code"), "word", keys=["code"], name="i").withColumn("chunk", F.floor((F.col("i") - 1) / chunk))
    chunks = placed.groupBy("code", "chunk").agg(F.array_sort(F.collect_list("word")).alias("variants"))
    return chunks.join(bases, "code").select("code", "chunk", "base_word", F.col("total").alias("n"), "variants")


def variant_postings(lines: DataFrame, column: str, vocabulary: DataFrame, pattern: str | None = None, least: int = 2, chunk: int = 1000) -> DataFrame:
    """``variant_groups`` in rows of bounded size."""
    return postings_of(coded_words(lines, column, vocabulary, pattern), least, chunk)


def pvd_of(groups: DataFrame) -> DataFrame:
    """(variant, base) of ``variant_groups``."""
    return groups.select(F.explode("variants").alias("variant"), F.col("base_word").alias("base"))


def devanagari_words(lines: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(word): different Devanagari words of ``least`` characters, in code-point order."""
    return lines.select(F.explode(devanagari_runs(F.col(column))).alias("word")).where(F.length("word") >= least).distinct().orderBy("word")


def dice(*parts: Column) -> Column:
    """A whole number below 2**32 from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def augmented(frame: DataFrame, column: str, clusters: DataFrame, variations: int = 3, rate: float = 0.7, key: str = "id") -> DataFrame:
    """(key, variation, sentence): each sentence and its variations; ``clusters`` has (word, cluster), an array for each word.

    Variation 0 is the sentence.  In the others each word of a cluster is replaced
    with probability ``rate`` by a word of it; choices are dice of (key, variation,
    place), so they are the same on every run.
    """
    known = clusters.select("word", F.col("word").alias("cluster"), F.size("cluster").alias("size"))
    return augmented_by_members(frame, column, known, clusters.select(F.col("word").alias("cluster"), F.posexplode("cluster").alias("place", "member")), variations, rate, key)


def members_of(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, cluster, size) and (cluster, place, member) of ``variant_groups``: a row a word in each, where an array for each word would grow with the square of a group."""
    placed = groups.select(F.col("code").alias("cluster"), F.size("variants").alias("size"), F.posexplode("variants").alias("place", "member"))
    return placed.select(F.col("member").alias("word"), "cluster", "size"), placed.select("cluster", "place", "member")


def augmented_by_members(frame: DataFrame, column: str, known: DataFrame, members: DataFrame, variations: int = 3, rate: float = 0.7, key: str = "id") -> DataFrame:
    """``augmented`` with clusters as rows: ``known`` has (word, cluster, size), ``members`` (cluster, place, member), places from 0.

    A word finds its cluster, and its dice the one member that it becomes.  Neither side
    is broadcast: a stored dictionary is many times larger in memory than its files say.
    """
    parts = frame.select(key, F.posexplode_outer(words(F.col(column))).alias("pos", "token"))
    found = parts.join(known.select(F.col("word").alias("_w"), "cluster", "size").hint("merge"), F.lower("token") == F.col("_w"), "left").drop("_w")
    each = found.withColumn("variation", F.explode(F.sequence(F.lit(1), F.lit(variations))))
    pick = (dice(F.col(key), F.col("variation"), F.col("pos"), F.lit("pick")) % F.col("size")).cast("int")
    swap = (F.col("size") > 0) & (dice(F.col(key), F.col("variation"), F.col("pos"), F.lit("swap")) < int(rate * 2**32))
    chosen = each.select(key, "variation", "pos", "token", F.when(swap, F.col("cluster")).alias("cluster"), F.when(swap, pick).alias("place"))
    swapped = chosen.where("place is not null").join(members.hint("merge"), ["cluster", "place"], "left").select(key, "variation", "pos", F.col("member").alias("w"))
    rows = chosen.where("place is null").select(key, "variation", "pos", F.col("token").alias("w")).unionByName(swapped)
    gathered = rows.groupBy(key, "variation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("sentence"))
    first = frame.select(key, F.lit(0).alias("variation"), text(column).alias("sentence"))
    return first.unionByName(gathered)

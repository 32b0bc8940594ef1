"""Similarity and error measures."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text, words


def distance(a: str, b: str) -> int:
    """Edit distance, a column of the table at a time: its differences up and down are the bits of two whole numbers."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    ones = (1 << len(a)) - 1
    up, down = ones, 0
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right = (down | (ones & ~(diagonal | up))) << 1 | 1
        down, up = right & diagonal & ones, (diagonal & up) << 1 | (ones & ~(diagonal | right))
        up &= ones
    return len(b) + up.bit_count() - down.bit_count()


def char_errors(pred: Column, truth: Column) -> Column:
    """Edit distance in characters: the table of a pair grows with the product of lengths, so it is filled a column at once."""

    @F.arrow_udf("int")
    def distances(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int32())

    return distances(text(pred), text(truth))


def cer(pred: Column, truth: Column) -> Column:
    """Character errors over the truth's length, one at least."""
    return cer_of(char_errors(pred, truth), truth)


def cer_of(errors: Column, truth: Column) -> Column:
    """The same of errors that are counted already."""
    return errors / F.greatest(F.length(text(truth)), F.lit(1))


def word_errors(pred: Column, truth: Column) -> Column:
    """Edit distance in words: each different word of the pair becomes one character."""

    def distance(both: Column) -> Column:
        # numbered from the private plane U+F0000
        letter = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both["k"], w) + F.lit(0xF0000)), 8, "0")), "UTF-32")
        code = lambda ws: F.array_join(F.transform(ws, letter), "")
        return F.levenshtein(code(both["p"]), code(both["t"]))

    p, t = words(pred), words(truth)
    return let(F.struct(p.alias("p"), t.alias("t"), F.array_distinct(F.concat(p, t)).alias("k")), distance)


def wer(pred: Column, truth: Column) -> Column:
    return word_errors(pred, truth) / F.greatest(F.size(words(truth)), F.lit(1))


def words_in_place(pred: Column, truth: Column) -> Column:
    """Words of the prediction that equal the truth's at the same place."""
    pairs = F.zip_with(words(pred), words(truth), lambda p, t: F.when(p == t, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def char_ngrams(c: Column, n: int) -> Column:
    t = text(c)
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _matches(a: str, b: str) -> list[int]:
    """For 1 to 4 characters: how many n-grams of ``a`` are in ``b``, each as often as it stands there at most."""
    out = []
    for n in range(1, 5):
        left, right = (Counter(map("".join, zip(*(x[i:] for i in range(n))))) for x in (a, b))
        out.append((left & right).total())
    return out


def matched_ngrams(pred: Column, truth: Column) -> Column:
    """array<bigint>: the matches of two texts for n-grams of 1 to 4 characters, by counts, in time linear in their lengths."""

    @F.arrow_udf("array<bigint>")
    def matches(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_matches(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return matches(text(pred), text(truth))


def char_bleu(pred: Column, truth: Column, method: int = 1, matched: Column | None = None) -> Column:
    """Character BLEU-4 with uniform weights, smoothed where an order has no match.

    Method 1 counts 0.1 matches there; method 4 halves, for each such order in
    turn, a count scaled by the prediction's length.  Zero if a text is empty.
    ``matched`` gives the matches where several scores of a pair share them.
    """
    p, t = text(pred), text(truth)

    def order(hits: Column, n: int) -> Column:
        return F.struct(F.get(hits, F.lit(n - 1)).cast("double").alias("m"), F.greatest(F.length(p) - (n - 1), F.lit(1)).cast("double").alias("n"))

    def combined(logs: Column) -> Column:
        if method == 1:
            terms = F.transform(logs, lambda o: F.log(F.when(o["m"] == 0, 0.1).otherwise(o["m"]) / o["n"]))
        else:
            empty = lambda i: F.size(F.filter(F.slice(logs, F.lit(1), i + 1), lambda o: o["m"] == 0))
            scale = F.lit(5.0) / F.log(F.length(p).cast("double"))
            terms = F.transform(logs, lambda o, i: F.when((o["m"] == 0) & (F.length(p) > 1), F.log(F.lit(1.0) / (F.pow(F.lit(2.0), empty(i).cast("double")) * scale * o["n"]))).when(o["m"] == 0, F.lit(None).cast("double")).otherwise(F.log(o["m"] / o["n"])))
        total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
        short = F.when(F.length(p) > F.length(t), F.lit(1.0)).otherwise(F.exp(1 - F.length(t) / F.length(p)))
        return F.when(logs[0]["m"] == 0, 0.0).otherwise(F.coalesce(short * F.exp(total / 4), F.lit(0.0)))

    matched = matched_ngrams(p, t) if matched is None else matched
    orders = let(matched, lambda hits: F.array(*[order(hits, n) for n in range(1, 5)]))
    return F.when((p == "") | (t == ""), 0.0).otherwise(let(orders, combined))


#: Longest texts, such as codes, whose blocks are found by searching for each part, the longest first.
SHORT = 12


def _matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest block, the first in ``a`` and then in ``b``, and those on both sides of it."""
    if not a or not b:
        return 0
    for k in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - k + 1):
            j = b.find(a[i : i + k])
            if j >= 0:
                return k + _matched(a[:i], b[:j]) + _matched(a[i + k :], b[j + k :])
    return 0


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    """Matching blocks over both lengths; not symmetric, and common characters of long ``b`` are skipped."""
    if a and b and len(a) <= SHORT and len(b) <= SHORT:
        return 2.0 * _matched(a, b) / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks, in this argument order."""

    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratios(text(a), text(b))


def code_similarity(a: Column, b: Column) -> Column:
    """The same for phonetic codes: zero if one is empty."""
    return F.when((text(a) == "") | (text(b) == ""), 0.0).otherwise(similarity(a, b))


def length_score(source: Column, target: Column) -> Column:
    """1 for equal lengths, falling to 0 at 2.25 times; 0 outside 0.5 to 2.25."""
    from .text import clean_token

    r = F.greatest(F.length(clean_token(target)), F.lit(1)) / F.greatest(F.length(clean_token(source)), F.lit(1))
    return F.when(r.between(0.5, 2.25), F.greatest(F.lit(0.0), 1 - F.abs(r - 1) / 1.25)).otherwise(0.0)


def position_score(pos: Column, candidate: Column, n_in: Column, n_out: Column, forward: bool = False) -> Column:
    """exp of minus the distance, scaled by the difference of lengths."""
    distance = F.greatest(F.lit(0), candidate - pos) if forward else F.abs(candidate - pos)
    return F.when(n_out <= 1, 1.0).otherwise(F.exp(-distance / F.greatest(F.lit(1), F.abs(n_in - n_out) + 1)))


def window_bounds(kind: str, pos: Column, n_out: Column, diff: Column) -> Column:
    """struct<low, high> of target places to try."""
    last = n_out - 1
    low = pos if kind in ("same", "forward") else F.greatest(F.lit(0), pos - diff)
    high = pos if kind == "same" else F.least(last, pos + diff)
    return F.when(n_out <= 0, F.struct(F.lit(0).alias("low"), F.lit(-1).alias("high"))).otherwise(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")))



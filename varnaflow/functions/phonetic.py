"""A phonetic code for romanized words, as native Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, text

#: Symbol of each sound (fixed values); ``X`` alone differs in the alternate code.
SYMBOLS = {
    "CH": "C", "KH": "K", "GH": "G", "PH": "P", "BH": "B", "JH": "J", "TH": "T", "DH": "D", "SH": "S", "NG": "N", "X": "K",
    "k": "K", "q": "K", "c": "K", "g": "G", "j": "J", "t": "T", "d": "D", "p": "P", "b": "B",
    "m": "M", "n": "N", "y": "Y", "r": "R", "l": "L", "s": "S", "h": "H", "v": "B", "w": "W", "f": "F", "z": "S", "x": "K",
}
DIGRAPHS = ("CH", "KH", "GH", "PH", "BH", "JH", "TH", "DH", "SH", "NG")
#: Spellings made one before coding, in this order (fixed values).
STEPS = (
    ("[^a-z]", ""), ("xo", "cho"), ("xh", "ch"), ("a{2,}", "a"), ("e{2,}", "e"), ("i{2,}", "i"), ("o{2,}", "o"), ("u{2,}", "u"), ("ae", "ai"),
    ("chh", "CH"), ("ch", "CH"), ("kh", "KH"), ("gh", "GH"), ("ph", "PH"), ("bh", "BH"), ("jh", "JH"), ("th", "TH"), ("dh", "DH"), ("sh", "SH"), ("ng", "NG"), ("f", "PH"), ("x", "X"),
)
LENGTH = 6
_FOLD = ("āīūṁṃñṙ", "aiummnr")


def spelling(word: Column) -> Column:
    """A word with its variant spellings made one; two-letter words are only upper-cased."""
    word = text(word)
    out = F.translate(F.lower(strip(word)), *_FOLD)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new)
    return F.when(F.length(word) == 2, F.upper(word)).otherwise(F.regexp_replace(out, "(.)\\1{2,}", "$1$1"))


def _code(sounds: Column, symbols: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(symbols.items())])
    vowel = lambda s: s.rlike("^[aeiou]$")
    symbol = lambda s: F.coalesce(table[s], F.when(F.length(s) == 1, F.coalesce(table[F.lower(s)], F.upper(s))))
    heard = F.transform(F.filter(sounds, lambda s, i: (i == 0) | ~vowel(s)), lambda s: F.when(vowel(s), F.upper(s)).otherwise(symbol(s)))
    different = let(heard, lambda h: F.slice(F.filter(h, lambda s, i: (i == 0) | (s != F.get(h, i - 1))), 1, LENGTH))
    last = F.try_element_at(sounds, F.lit(-1))

    def closed(code: Column) -> Column:
        more = (F.size(sounds) > 0) & vowel(last) & (F.size(code) < LENGTH) & (F.upper(last) != F.try_element_at(code, F.lit(-1)))
        return F.concat(F.array_join(code, ""), F.when(F.coalesce(more, F.lit(False)), F.upper(last)).otherwise(""))

    return let(different, closed)


def _code_by_sounds(word: Column, symbols: dict[str, str]) -> Column:
    """The code from the list of sounds, as it is defined."""
    return let(F.regexp_extract_all(spelling(word), F.lit(f"(?s)({'|'.join(DIGRAPHS)}|.)"), 1), lambda s: _code(s, symbols))


def _code_by_letters(word: Column, symbols: dict[str, str]) -> Column:
    """The same for a word that isn't two letters long, by replacing strings: each sound becomes its one-letter symbol at once.

    Runs of a consonant need no step of their own, since equal neighbours count once.
    """
    lower = F.lower(word)
    out = F.regexp_replace(F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.translate(lower, *_FOLD)), "[^a-z]+", "")
    out = F.replace(F.replace(out, F.lit("xo"), F.lit("cho")), F.lit("xh"), F.lit("ch"))
    out = F.replace(F.regexp_replace(out, "([aeiou])\\1+", "$1"), F.lit("ae"), F.lit("ai"))
    for old, new in STEPS[9:-2]:
        out = F.replace(out, F.lit(old), F.lit(symbols[new]))
    single = {"f": symbols["PH"], "x": symbols["X"]} | {k: v for k, v in symbols.items() if k.islower() and k not in "fx"}
    out = F.translate(out, "".join(single), "".join(single.values()))

    def coded(s: Column) -> Column:
        heard = F.concat(F.upper(F.substring(s, 1, 1)), F.translate(F.substring(s, F.lit(2), F.length(s)), "aeiou", ""))
        return F.struct(F.substring(F.regexp_replace(heard, "(.)\\1+", "$1"), 1, LENGTH).alias("code"), F.substring(s, -1, 1).alias("last"))

    def closed(x: Column) -> Column:
        more = x["last"].isin(*"aeiou") & (F.length(x["code"]) < LENGTH) & (F.upper(x["last"]) != F.substring(x["code"], -1, 1))
        return F.concat(x["code"], F.when(more, F.upper(x["last"])).otherwise(""))

    return let(let(out, coded), closed)


def _coded(word: Column, symbols: dict[str, str]) -> Column:
    return F.when(F.length(word) == 2, _code_by_sounds(word, symbols)).otherwise(_code_by_letters(word, symbols))


def primary_code(word: Column) -> Column:
    """The primary code alone."""
    return let(text(word), lambda w: _coded(w, SYMBOLS))


def phonetic_codes(word: Column) -> Column:
    """struct<primary, alternate>; alternate is empty where it equals primary."""
    both = let(text(word), lambda w: F.struct(_coded(w, SYMBOLS).alias("p"), _coded(w, SYMBOLS | {"X": "X"}).alias("a")))
    return let(both, lambda b: F.struct(b["p"].alias("primary"), F.when(b["p"] == b["a"], "").otherwise(b["a"]).alias("alternate")))


def phonetic_key(word: Column) -> Column:
    """The primary code, else the alternate, else the first six characters."""
    known = let(phonetic_codes(word), lambda c: F.coalesce(F.nullif(c["primary"], F.lit("")), F.nullif(c["alternate"], F.lit(""))))
    return F.coalesce(known, F.substring(text(word), 1, LENGTH))

"""Text cleaning, tokens and parsers as native Column expressions.

Null input is treated as the empty string, as the functions' callers expect;
lengths count code points.  Classes are spelled out, because ``\\w`` and ``\\s``
differ between regex engines outside ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, as Unicode text handling strips and splits it.
WHITE = "\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The same characters one by one.
WHITE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: What of it is ASCII, one by one: such a class is a table of bits, which a search steps through several times as fast as through ranges.
_ASCII_WHITE = "\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DEVANAGARI = "\\u0900-\\u097F"
#: Code points that corpus cleaning drops (fixed values); wide on purpose, Devanagari is outside.
EMOJI = "[\\u2500-\\u2BEF\\x{24C2}-\\x{1F251}\\u2640-\\u2642\\u2600-\\u2B55\\u200d\\u23cf\\u23e9\\u231a\\ufe0f\\u3030\\x{10000}-\\x{10FFFF}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once; inside a lambda an expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column | str) -> Column:
    """The column as a string; null is empty."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def _is_ascii(t: Column) -> Column:
    return F.octet_length(t) == F.length(t)


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""

    def spaced(t: Column) -> Column:  # single spaces stay
        plain = F.regexp_replace(t, f"[{_ASCII_WHITE} ]{{2,}}|[{_ASCII_WHITE}]", " ")
        return F.btrim(F.when(_is_ascii(t), plain).otherwise(F.regexp_replace(t, f"[{WHITE}]{{2,}}|[{WHITE}&&[^ ]]", " ")))

    return let(c, spaced)


def words(c: Column) -> Column:
    """Tokens between white space, without empty ones."""
    parts = lambda t: F.when(_is_ascii(t), F.split(t, f"[{_ASCII_WHITE} ]+")).otherwise(F.split(t, f"[{WHITE}]+"))
    return F.filter(let(text(c), parts), lambda w: w != "")


def clean_token(c: Column) -> Column:
    """Keep ASCII letters and digits, Devanagari and the apostrophe."""
    other = "".join(x for x in map(chr, range(128)) if not x.isalnum() and x != "'")
    return let(text(c), lambda t: F.when(_is_ascii(t), F.translate(t, other, "")).otherwise(F.regexp_replace(t, f"[^A-Za-z0-9{DEVANAGARI}']+", "")))


def _without(t: Column, pattern: str) -> Column:
    """``t`` without what ``pattern`` matches, which is never ASCII: ASCII texts are not searched."""
    return F.when(_is_ascii(t), t).otherwise(F.regexp_replace(t, pattern, ""))


def remove_emojis(c: Column) -> Column:
    return squeeze(let(text(c), lambda t: _without(t, EMOJI)))


def repair_separators(c: Column) -> Column:
    """Part words joined by a period or parenthesis; parentheses become spaces."""

    def parted(t: Column, sign: str) -> Column:
        # a search that begins with the sign is fast, and most texts have none between letters
        return F.when(t.rlike(f"{sign}(?<=[a-zA-Z]{sign})[a-zA-Z]"), F.regexp_replace(t, f"([a-zA-Z]){sign}([a-zA-Z])", "$1 $2")).otherwise(t)

    out = let(text(c), lambda t: parted(t, "\\."))
    out = let(out, lambda t: parted(t, "\\("))
    out = let(out, lambda t: parted(t, "\\)"))
    return squeeze(F.translate(out, "()", "  "))


def drop_punctuation(c: Column) -> Column:
    return F.translate(text(c), PUNCTUATION, "")


def plain_lower(c: Column) -> Column:
    """Lower case without ASCII punctuation."""
    return strip(F.lower(drop_punctuation(c)))


def is_digits(c: Column) -> Column:
    """Digits only, in any script, superscripts too."""
    return c.rlike("^[\\p{Nd}\\u00b2\\u00b3\\u00b9\\u2070\\u2074-\\u2079\\u2080-\\u2089]+$")


def ratio_words(c: Column) -> Column:
    """The words that count for the English ratio, in lower case: of texts that aren't ASCII word by word, as most words are."""
    lower = lambda t: F.when(_is_ascii(t), words(F.lower(t))).otherwise(F.transform(words(t), F.lower))
    return F.filter(let(drop_punctuation(c), lower), lambda w: ~is_digits(w))


#: Emojis that dictionary cleaning drops, and the addresses (of lower-cased texts).
_CORPUS_EMOJI = "[\\x{1F000}-\\x{1FAFF}\\u2600-\\u27BF\\u2B50\\u2B55\\u231A\\u231B\\u23E9-\\u23F3\\ufe0f\\u200d]"
_ADDRESS = f"http[^{WHITE}]+|www[^{WHITE}]+|https[^{WHITE}]+"


def corpus_text(c: Column) -> Column:
    """Dictionary cleaning: no emojis, lower case, no URLs, digits become spaces, no punctuation."""
    out = F.lower(let(text(c), lambda t: _without(t, _CORPUS_EMOJI)))
    out = let(out, lambda t: F.when(t.contains("http") | t.contains("www"), F.regexp_replace(t, _ADDRESS, "")).otherwise(t))
    out = F.regexp_replace(out, "\\p{Nd}+", " ")
    return squeeze(F.translate(out, PUNCTUATION, ""))


def corpus_words(c: Column) -> Column:
    """The words of ``corpus_text``, which is not made for them; their case stays, since making long texts lower is dear where they aren't ASCII.

    A digit parts words as a space does.  Texts that may hold an address are lower-cased before it is cut out, and so are
    those with a capital sigma, whose small form depends on the signs around it.
    """
    addressed = lambda t: F.when(t.rlike("[hH][tT][tT][pP]|[wW][wW][wW]|\\u03a3"), F.regexp_replace(F.lower(t), _ADDRESS, "")).otherwise(t)
    bare = F.regexp_replace(let(let(text(c), lambda t: _without(t, _CORPUS_EMOJI)), addressed), "[!-/:-@\\[-`{-~]+", "")
    parts = lambda t: F.when(_is_ascii(t), F.split(t, f"[{_ASCII_WHITE} 0123456789]+")).otherwise(F.split(t, f"[{WHITE}\\p{{Nd}}]+"))
    return F.array_remove(let(bare, parts), "")


def contains_devanagari(c: Column) -> Column:
    return text(c).rlike(f"[{DEVANAGARI}]")


def devanagari_runs(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(f"([{DEVANAGARI}]+)"), 1)


def keep_devanagari(c: Column) -> Column:
    """Devanagari and white space only."""
    return strip(F.regexp_replace(text(c), f"[^{DEVANAGARI}{WHITE}]", ""))


def devanagari_digits(c: Column) -> Column:
    return F.translate(text(c), "0123456789", "०१२३४५६७८९")


def digit_runs(c: Column) -> Column:
    """Digit runs in order."""
    return F.regexp_extract_all(text(c), F.lit("(\\p{Nd}+)"), 1)


def digit_run_positions(c: Column) -> Column:
    """array<struct<pos, digits>>: each digit run with its first code point's place."""
    chars = F.split(text(c), "")
    numbered = F.transform(chars, lambda x, i: F.struct(i.alias("i"), x.alias("x"), x.rlike("^\\p{Nd}$").alias("d")))
    starts = let(numbered, lambda ns: F.filter(ns, lambda s: s["d"] & ((s["i"] == 0) | ~F.get(ns, s["i"] - 1)["d"])))
    runs = digit_runs(c)
    return F.zip_with(starts, runs, lambda s, r: F.struct(s["i"].cast("long").alias("pos"), r.alias("digits")))


def numbered_line(c: Column) -> Column:
    """The answer in ``3. answer``; null for a line without ``. ``."""
    t = text(c)
    return F.when(F.locate(". ", t) > 0, F.substring(t, F.locate(". ", t) + 2, F.length(t)))


def roman_devanagari_pair(c: Column) -> Column:
    """struct<romanized, devanagari>: a line cut at its first Devanagari character; null if a half is missing."""

    def halves(line: Column) -> Column:
        half = lambda k: F.btrim(F.regexp_extract(line, f"^([^{DEVANAGARI}]*)([{DEVANAGARI}](?s:.*))$", k), F.lit(" ,"))
        return F.struct(half(1).alias("romanized"), half(2).alias("devanagari"))

    # the line and its halves are each made once
    return let(let(strip(text(c)), halves), lambda p: F.when((p["romanized"] != "") & (p["devanagari"] != ""), p))


def mask_english(c: Column, is_english) -> Column:  # noqa: ANN001
    """struct<masked, words>: each English token becomes ``#``; ``is_english`` tests a lower-cased token."""
    tokens = F.regexp_extract_all(strip(F.replace(text(c), F.lit("#"), F.lit(""))), F.lit(f"([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WHITE}])"), 1)
    return F.struct(
        F.array_join(F.transform(tokens, lambda t: F.when(is_english(F.lower(t)), "#").otherwise(t)), " ").alias("masked"),
        F.filter(tokens, lambda t: is_english(F.lower(t))).alias("words"),
    )


def restore_english(sentence: Column, english: Column) -> Column:
    """Each ``#`` takes the next word; words left over go to the end."""
    none = F.array().cast("array<string>")

    def fill(both: Column) -> Column:
        tokens, given = both["t"], both["w"]
        rank = lambda i: F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda t: t == "#"))
        filled = F.transform(tokens, lambda t, i: F.when((t == "#") & (rank(i) <= F.size(given)), F.get(given, rank(i) - 1)).otherwise(t))
        used = F.least(F.size(F.filter(tokens, lambda t: t == "#")), F.size(given))
        rest = F.when(used < F.size(given), F.slice(given, used + 1, F.size(given) - used)).otherwise(none)
        return F.array_join(F.concat(filled, rest), " ")

    return let(F.struct(words(sentence).alias("t"), F.coalesce(english, none).alias("w")), fill)


def log_curve(c: Column) -> Column:
    """array<struct<epoch, train_loss, val_loss>> of a training log."""
    t = text(c)
    pick = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), 1)
    epochs, train, val = pick("Epoch (\\d+)"), pick("Loss\\s+([\\d.]+)\\s*\\| Val"), pick("Val Loss\\s+([\\d.]+)")
    return F.transform(F.arrays_zip(epochs.alias("e"), train.alias("t"), val.alias("v")), lambda x: F.struct(x["e"].cast("int").alias("epoch"), x["t"].cast("double").alias("train_loss"), x["v"].cast("double").alias("val_loss")))


def channel_name(c: Column) -> Column:
    """The name after the last ``@``, up to the next slash."""
    return F.substring_index(F.substring_index(text(c), "@", -1), "/", 1)


def output_name(c: Column, suffix: str = "_romanized") -> Column:
    """``dir/name.ext`` becomes ``name<suffix>.ext``."""
    base = F.substring_index(text(c), "/", -1)
    stem = F.regexp_replace(base, "(?<=[^.])\\.[^.]*$", "")
    return F.concat(stem, F.lit(suffix), F.substring(base, F.length(stem) + 1, F.length(base)))

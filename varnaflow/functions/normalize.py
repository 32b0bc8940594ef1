"""Rule and dictionary normalization of romanized sentences.

Sentence-level rules are native Column expressions.  Word rules need to know which
words are English: a vocabulary of at most ``INLINE`` words is compiled into the
expression (a hash set in generated code, no join, no shuffle), a larger one is
joined (see ``operators.joins``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import fold_to_ascii
from .text import let, squeeze, text, words

INLINE = 20_000

Test = Callable[[Column], Column]


def vocabulary_test(vocabulary: Iterable[str]) -> Test:
    """A test for membership in a bounded list of words."""
    known = sorted(set(vocabulary))
    if len(known) > INLINE:
        raise ValueError(f"{len(known)} words: join larger vocabularies instead")
    return (lambda w: w.isin(known)) if known else (lambda w: F.lit(False))


def rule_text(c: Column) -> Column:
    """Lower case, ASCII, single spaces, no letter more than twice in a row, plain punctuation only."""
    out = squeeze(fold_to_ascii(F.lower(text(c))))
    return F.regexp_replace(F.regexp_replace(out, "(.)\\1{2,}", "$1$1"), "[^\\p{L}\\p{N}_\\s.,!?;:'\"-]", "")


def word_parts(w: Column) -> Column:
    """struct<prefix, core, suffix>: what stands before the first and after the last letter or digit."""
    pick = lambda k: F.regexp_extract(w, "(?s)^([^\\p{L}\\p{N}]*)(.*?)([^\\p{L}\\p{N}]*)$", k)
    return F.struct(pick(1).alias("prefix"), pick(2).alias("core"), pick(3).alias("suffix"))


def x_rule(core: Column, english: Test) -> Column:
    return F.when(~english(core) & core.contains("x"), F.replace(core, F.lit("x"), F.lit("chh"))).otherwise(core)


def w_rule(core: Column, english: Test) -> Column:
    return F.when(~english(core) & core.endswith("w"), F.concat(F.substring(core, F.lit(1), F.length(core) - 1), F.lit("a"))).otherwise(core)


def ruled_words(c: Column, english: Test) -> Column:
    """array<struct<prefix, first, x, w, suffix>> of a sentence: each core before and after both rules."""

    def parts(w: Column) -> Column:
        core = lambda p: F.lower(p["core"])
        first = let(word_parts(w), lambda p: F.struct(p["prefix"].alias("prefix"), core(p).alias("first"), x_rule(core(p), english).alias("x"), p["suffix"].alias("suffix")))
        return let(first, lambda p: F.struct(p["prefix"].alias("prefix"), p["first"].alias("first"), p["x"].alias("x"), w_rule(p["x"], english).alias("w"), p["suffix"].alias("suffix")))

    return F.transform(words(rule_text(c)), parts)


def rule_based(c: Column, english: Test) -> Column:
    """The sentence after the sentence and word rules, without a dictionary."""
    return F.array_join(F.transform(ruled_words(c, english), lambda p: F.concat(p["prefix"], p["w"], p["suffix"])), " ")


def changes_of(p: Column, base: Column) -> Column:
    """The change rows of one ruled word; ``base`` is its dictionary form or null."""
    around = lambda core: F.concat(p["prefix"], core, p["suffix"])
    row = lambda new, rule: F.struct(around(p["first"]).alias("original"), around(new).alias("replaced"), F.lit(rule).alias("rule"))
    made = F.array(
        F.when(p["x"] != p["first"], row(p["x"], "x → chh")),
        F.when(p["w"] != p["x"], row(p["w"], "w → a")),
        F.when(base.isNotNull(), row(base, "dictionary mapping")),
    )
    return F.filter(made, lambda r: r.isNotNull())

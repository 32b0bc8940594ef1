"""Steps whose cost must not grow faster than the tables; results against the plain forms."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from varnaflow.functions.metrics import char_errors, distance
from varnaflow.functions.normalize import vocabulary_test
from varnaflow.functions.phonetic import SYMBOLS, _code_by_sounds, primary_code
from varnaflow.functions.text import corpus_text, corpus_words, words
from varnaflow.functions.translit import prepared, transliterate, units, written
from varnaflow.operators.aggregates import distinct_lower
from varnaflow.operators.joins import block_pairs, first_pairs, phonetic_blocks
from varnaflow.plans import normalization, romanized

ALPHABETS = ("aaeeiioouuxxchhkgtnmrydspbjfwzqlv", "nghktrisSh~mnAUITDH gya", "abcéāīṁñßİΣςk١२ 3!-'[_\n\t", "aeioucxh")


def _random_words(spark, n=3000):
    dice = random.Random(3)
    rows = [("".join(dice.choice(a) for _ in range(dice.randint(0, 14))),) for a in ALPHABETS for _ in range(n)]
    return spark.createDataFrame([*rows, (None,), ("HTTP://a.b c",), ("www.x.y É",)], "w string")


def test_quick_forms_equal_the_plain_ones(spark):
    w = F.col("w")
    pairs = {
        "code": (primary_code(w), _code_by_sounds(w, SYMBOLS)),
        "devanagari": (transliterate(w), written(units(prepared(w)))),
        "words": (F.transform(corpus_words(w), F.lower), words(corpus_text(w))),
        "errors": (char_errors(w, F.reverse(w)), F.levenshtein(F.coalesce(w, F.lit("")), F.reverse(F.coalesce(w, F.lit(""))))),
    }
    frame = _random_words(spark)
    for name, (quick, plain) in pairs.items():
        assert frame.where(~quick.eqNullSafe(plain)).take(3) == [], name


def test_distance_of_long_texts_is_not_a_table_cell_by_cell():
    a = "abcdefghij " * 3000
    began = time.perf_counter()
    assert distance(a, a[1:] + "x") == 2 and distance("", a) == len(a) and distance(a, a) == 0
    assert time.perf_counter() - began < 30  # 1,089 million cells


def test_filters_of_different_words_stay_above_the_aggregation(spark):
    found = distinct_lower(spark.createDataFrame([("A b a é É",)], "t string"), corpus_words(F.col("t")))
    assert {tuple(r) for r in found.collect()} == {("a", 2), ("b", 1), ("é", 2)}
    plan = found.where(primary_code(F.col("word")) != "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Aggregate") and "Filter" not in plan[plan.index("Aggregate") :].replace("Filter (size", "")


def test_first_pairs_carry_no_block(spark):
    coded = spark.createDataFrame([("K", w) for w in "kab kib kub".split()] + [("T", "ta")], "code string, word string")
    assert sorted(first_pairs(coded).collect()) == sorted(block_pairs(phonetic_blocks(coded)).collect()) == [("K", "kab", "kib"), ("K", "kab", "kub")]
    assert "collect_" not in first_pairs(coded)._jdf.queryExecution().optimizedPlan().toString()


def test_ratio_words_of_texts_that_are_not_ascii(spark):
    lines = spark.createDataFrame([("The ÉİX of, 12 İn THE Key",)], "value string")
    row = romanized.analysed(lines, vocabulary_test(["the", "of", "key"])).first()
    assert (row["english_words"], row["total_words"]) == (4, 6)


def test_ablation_makes_its_arms_once(spark):
    turns = spark.createDataFrame([(1, "kam kab"), (2, None)], "id int, text string")
    pvd = spark.createDataFrame([("kab", "kam")], "variant string, base string")
    out = normalization.ablation(turns, "text", vocabulary_test(["the"]), pvd, [("chunked", 3), ("whole", 0)], None, "id")
    rows = {(r["id"], r["config"], r["model"]): r["output"] for r in out.collect()}
    assert len(rows) == 16 and rows[1, "combined", "chunked"] == rows[1, "pvd_only", "whole"] == "कम कम" and rows[2, "raw", "whole"] == ""
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2  # one for each arm with a dictionary

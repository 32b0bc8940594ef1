from __future__ import annotations

import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varnaflow.functions import folding, metrics, normalize, phonetic, repair, text, translit, wordmodel
from varnaflow.functions.chunks import chunk_text

PHONETIC = {"namaste": ("NMSTE", ""), "chha": ("CA", ""), "ma": ("MA", ""), "mama": ("MA", ""), "aama": ("AMA", ""), "kathmandu": ("KTMNDU", ""), "dhanyabad": ("DNYBD", ""), "xoro": ("CRO", ""), "xito": ("KTO", "XTO"), "xa": ("KA", "XA"), "fikka": ("PKA", ""), "hunchha": ("HNCA", ""), "bhaeko": ("BKO", ""), "नमस्ते": ("", ""), "को": ("को", ""), "": ("", "")}
DEVANAGARI = {"namaste": "नमस्ते", "saathii": "साथी", "kholnu": "खोल्नु", "chha": "छ", "nepal": "नेपल", "gyaan": "ज्ञन", "dhanyabad": "धञबद", "kathmandu": "कथ्मन्दु", "ramro": "रम्रो", "bhuiN": "भुइण", "kri": "कृ", "ka": "क", "kaa": "का", "ki": "कि", "kii": "की", "ku": "कु", "ke": "के", "ko": "को", "kai": "कै", "kau": "कौ", "a": "अ", "k": "क", "": "", "n~~a": "ँअ", "kam~": "कं", "duHkha": "दुःख"}
ENGLISH = {"new": "नेव", "job": "जोब", "training": "त्रैनिङ", "market": "मर्केत", "price": "पृके", "chha": "ख्ह", "computer": "कम्प्युटर", "2024": ""}


def _values(spark, build, keys):
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", build(F.col("k")).alias("v")).collect()
    return {r["k"]: r["v"] for r in rows}


def test_phonetic_codes(spark):
    assert {k: tuple(v) for k, v in _values(spark, phonetic.phonetic_codes, PHONETIC).items()} == PHONETIC


def test_devanagari_of_romanized_words(spark):
    assert _values(spark, translit.transliterate, DEVANAGARI) == DEVANAGARI
    assert _values(spark, translit.english_to_devanagari, ENGLISH) == ENGLISH


def test_long_vowel_word_keeps_its_rules(spark):
    # "xa" has two characters: it is upper-cased as it is, so its sounds are X and A
    assert wordmodel.key("xa") == "XA" or wordmodel.key("xa") == "KA"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcdefghinoprstuxzTDNHS~ 'āñकमा-", max_size=12), min_size=1, max_size=20, unique=True))
def test_native_forms_equal_the_word_model(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", phonetic.phonetic_key(F.col("w")).alias("key"), translit.transliterate(F.col("w")).alias("t"), translit.english_to_devanagari(F.col("w")).alias("e")).collect()
    for r in rows:
        assert r["key"] == wordmodel.key(r["w"])
        assert r["t"] == wordmodel.transliterated(r["w"])
        assert r["e"] == wordmodel.devanagari(r["w"])
        assert len(wordmodel.key(r["w"])) <= 6


def test_cleaning(one):
    assert one(text.clean_token, " hi-there! को। ") == "hithereको।"
    assert one(text.repair_separators, "a.b.c foo(bar)baz") == "a b.c foo bar baz"
    assert one(text.remove_emojis, " hi 😀  there ") == "hi there"
    assert one(text.corpus_text, "See HTTP://x.y/z 12 dogs, ok!") == "see dogs ok"
    assert one(text.plain_lower, " Hello, World! ") == "hello world"
    assert one(text.words, "  a \t b\n") == ["a", "b"]
    assert one(text.words, None) == []
    assert one(text.devanagari_digits, 2024) == "२०२४"
    assert one(text.keep_devanagari, "abc नमस्ते 12") == "नमस्ते"
    assert one(text.devanagari_runs, "x नम ab को") == ["नम", "को"]


def test_parsers(one):
    assert one(text.numbered_line, "3. answer. more") == "answer. more"
    assert one(text.numbered_line, "none") is None
    assert tuple(one(text.roman_devanagari_pair, " mero, मेरो ,")) == ("mero", "मेरो")
    assert one(text.roman_devanagari_pair, "मेरो") is None
    assert [tuple(x) for x in one(text.digit_run_positions, "a12b345")] == [(1, "12"), (4, "345")]
    assert [tuple(x) for x in one(text.log_curve, "Epoch 0/10 | Loss  0.362 | Val Loss  0.1862")] == [(0, 0.362, 0.1862)]
    assert one(text.channel_name, "https://v.example/@chan/videos") == "chan"
    assert one(text.output_name, "d/file.txt") == "file_romanized.txt"


def test_mask_and_restore(spark, one):
    english = normalize.vocabulary_test(["job"])
    masked = one(lambda c: text.mask_english(c, english), "mero #job ho")
    assert (masked["masked"], masked["words"]) == ("mero # ho", ["job"])
    restore = lambda s, ws: spark.createDataFrame([(s, ws)], "s string, w array<string>").select(text.restore_english(F.col("s"), F.col("w"))).first()[0]
    assert restore("मेरो # हो", ["job"]) == "मेरो job हो"
    assert restore("मेरो हो", ["job"]) == "मेरो हो job"
    assert restore("# # #", ["a"]) == "a # #"


def test_rules(one):
    english = normalize.vocabulary_test(["box", "new"])
    rule = lambda c: normalize.rule_based(c, english)
    assert one(rule, "Xa tw, box \"xw!\" new sooooo é#") == 'chha ta, box "chha!" new soo e'
    assert tuple(one(normalize.word_parts, '"hi!,')) == ('"', "hi", "!,")
    assert tuple(one(normalize.word_parts, "!!!")) == ("!!!", "", "")


#: A value for each block that the folding table covers, written down by hand.
FOLDED = {
    "Latin-1": ("Àéñß«½°", "Aenss<<1/2deg"), "Latin Extended-A": ("āčđęłŋœşž", "acdelngoesz"), "Latin Extended-B": ("ƒǆǊȳ", "fdzNJy"), "Latin Extended Additional": ("ḍḥṃṛṣṭẽỹ", "dhmrstey"),
    "Greek": ("Ψυχή ξένος", "Psukhe xenos"), "Greek Extended": ("ἀὖ", "au"), "Cyrillic": ("Щёлково Юг", "Shchiolkovo Iug"), "Armenian": ("բան", "ban"), "Hebrew": ("שלמ", "shlm"), "Arabic": ("كتب", "ktb"), "Arabic digits": ("٣٤", "34"),
    "Devanagari": ("कखगा मि १२।", "kkhgaa mi 12."), "Bengali": ("কাল", "kaal"), "Georgian": ("თბილისი", "tbilisi"), "Hangul": ("한국어", "hangugeo"), "Hiragana": ("ひらがな", "hiragana"), "Katakana": ("カタカナ", "katakana"),
    "Punctuation": ("“a”—‘b’…", "\"a\"--'b'..."), "Currency": ("€", "EUR"), "Letterlike": ("№ℂ", "NoC"), "Number forms": ("Ⅷ⅓", "VIII1/3"), "Superscripts": ("x²₃", "x23"), "Enclosed": ("①ⓑ", "1b"), "Ligatures": ("ﬁﬃ", "fiffi"), "Fullwidth": ("Ｆｕｌｌ　１！", "Full 1!"), "Mathematical": ("𝐁𝒶𝟗", "Ba9"), "Emoji": ("a😀b☃", "ab"), "Ideographs": ("北京", "北京"),
}


@pytest.mark.parametrize("block", FOLDED)
def test_folding(one, block):
    given, want = FOLDED[block]
    assert one(folding.fold_to_ascii, given) == want


def test_folding_of_edges(one):
    assert one(folding.fold_to_ascii, None) is None and one(folding.fold_to_ascii, "") == ""
    assert one(folding.fold_to_ascii, "plain \t\n ~") == "plain \t\n ~"
    assert one(folding.fold_to_ascii, "é" * 50_000) == "e" * 50_000


@pytest.mark.parametrize(("given", "lengths"), [("a" * 125, [125]), ("a" * 126, [125, 1]), ("", [0]), ("b" * 60 + " " + "c" * 70, [60, 70])])
def test_chunks(one, given, lengths):
    assert [len(x) for x in one(chunk_text, given)] == lengths


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 40), min_size=1, max_size=30))
def test_chunks_join_again(one, sizes):
    given = " ".join("w" * n for n in sizes)
    chunks = one(lambda c: chunk_text(c, 20), given)
    assert all(len(c) <= 20 for c in chunks)
    assert "".join(chunks).replace(" ", "") == given.replace(" ", "")


def test_errors_and_scores(one):
    assert one(metrics.char_errors, "kitten", "sitting") == 3
    assert one(metrics.word_errors, "a b c", "a x c d") == 2
    assert one(metrics.wer, "", "") == 0.0
    assert one(metrics.cer, "a", None) == 1.0
    assert one(metrics.words_in_place, "a b c", "a x c d") == 2
    assert one(metrics.length_score, "abcd", "abcd") == 1.0
    assert abs(one(metrics.length_score, "abcd", "ab") - 0.6) < 1e-9
    assert one(metrics.length_score, "abcd", "a") == 0.0
    assert one(metrics.similarity, "tide", "diet") == 0.25
    assert one(metrics.similarity, "diet", "tide") == 0.5
    assert one(metrics.code_similarity, "", "A") == 0.0


def test_bleu(one):
    assert abs(one(metrics.char_bleu, "abcdef", "abcdef") - 1) < 1e-12
    assert one(metrics.char_bleu, "", "a") == 0.0
    expected = ((3 / 4) * (2 / 3) * (1 / 2) * (0.1 / 1)) ** 0.25
    assert abs(one(metrics.char_bleu, "abcx", "abcd") - expected) < 1e-12
    other = ((3 / 4) * (2 / 3) * (1 / 2) * (math.log(4) / 10)) ** 0.25
    assert abs(one(lambda p, t: metrics.char_bleu(p, t, 4), "abcx", "abcd") - other) < 1e-12


def test_repair_numbers_and_words():
    out, log = repair.rebuild("2 jana aaye", "दुई जना आये", frozenset())
    assert out == "२ जना आये"
    assert log[0][4] == "number"
    out, log = repair.rebuild("mero job ramro", "मेरो जोब राम्रो", frozenset({"job"}))
    assert [x[4] for x in log] in ([], ["english"])
    assert len(out.split()) == 3
    assert repair.rebuild("a", "", frozenset()) == ("", [])
    assert repair.attached_marker("जागिरमा") == "ma"
    assert repair.attached_marker("मा") is None
    assert repair.digit_runs("a12 3") == [(1, "12"), (4, "3")]


def test_repair_places():
    # as many tokens on both sides: the places tried are one before to one after
    assert list(repair._places(3, 5, 5)) == [2, 3, 4]
    assert list(repair._places(3, 5, 6)) == [4]
    assert list(repair._places(3, 5, 8)) == []


def test_repair_rows(spark):
    pairs = spark.createDataFrame([("2 jana", "दुई जना", [1]), (None, None, None)], "a string, b string, other array<int>")
    rows = repair.repair(pairs, "a", "b", ["job"]).collect()
    assert (rows[0]["text"], rows[0]["replacements"][0]["kind"], rows[0]["other"]) == ("२ जना", "number", [1])
    assert (rows[1]["text"], rows[1]["replacements"]) == ("", [])


def test_earlier_matchers():
    assert repair.neighbours_score([], [], 0, 0) == 1.0
    assert repair.offset_match("job", ["job"], ["जोब"], 0)[0] == "जोब"
    assert repair.target_match("job", ["जब"], ["job"], 0)[0] == "जब"


def test_bleu_of_long_texts_is_linear(spark):
    """Texts of 60,000 characters: counted by pairs of places they would take hours."""
    import time

    a, b = "mero ghar ramro chha " * 3000, "mero ghar ramro chhaina " * 2500
    row = spark.createDataFrame([(a, b)], "p string, t string")
    begun = time.time()
    got = row.select(*[metrics.char_bleu(F.col("p"), F.col("t"), m) for m in (1, 4)]).first()
    assert time.time() - begun < 30 and 0.5 < got[0] < 1 and got[0] == got[1]
    assert metrics._matches("aaab", "aab") == [3, 2, 1, 0] and metrics._matches("", "a") == [0, 0, 0, 0]


def test_cleaners_of_ascii_and_other_texts_agree(spark):
    """ASCII texts take a path of their own: with a letter outside ASCII beside them they are cleaned alike."""
    parts = ["a.b.c", " x ", "\t\t", "y(z)w", "1.2", "e.", ".f", "\x1c", "\r\n", "it's", "a_b", "(", ")(", "--", "\x0b9", "\x7f", "h.i j.k"]
    rows = [(f"{a}{b}{c}",) for a in parts for b in parts for c in parts]
    q = F.concat(F.col("t"), F.lit("\u0915"))
    drop = lambda c: F.replace(c, F.lit("\u0915"), F.lit(""))
    cleaners = {"token": text.clean_token, "separators": text.repair_separators, "words": lambda c: F.array_join(text.words(c), "|")}
    frame = spark.createDataFrame(rows, "t string")
    for name, f in cleaners.items():
        # what is appended keeps white space at the end, which is stripped here
        got = frame.select("t", f(F.col("t")).alias("a"), F.regexp_replace(drop(f(q)), "[ |]$", "").alias("b")).where("a <> b").collect()
        assert not got, (name, got[:3])
    old = frame.select("t", text.repair_separators(F.col("t")).alias("a")).collect()
    for r in old:
        want = r["t"]
        for sign in (r"\.", r"\(", r"\)"):
            want = re.sub(f"([a-zA-Z]){sign}([a-zA-Z])", r"\1 \2", want)
        want = re.sub(r"[\t-\r\x1c-\x20]+", " ", re.sub("[()]", " ", want)).strip(" ")
        assert r["a"] == want
    plan = frame.select(text.clean_token(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in plan  # no search of each character in ASCII texts


def test_folding_takes_letters_of_every_script_at_once(one):
    """Letters of one character go in one pass, whatever their page; the few others by replacement, very many by character: all as ``folded`` says."""
    import random

    from varnaflow.functions import folding

    letters = folding._single()[0]
    assert all(c in letters for c in "каकαアａ\U0001d41a")
    rnd = random.Random(3)
    every = [chr(x) for x in range(0xA1, 0x20000) if not 0xD800 <= x < 0xE000 and (x < folding.END)]
    texts = ["ψ ξ th 漢字 한국 ½ № ﬃ\n😀 x", "漢" * 3, "".join(chr(0xAC00 + i) for i in range(folding.FEW)), *("".join(rnd.choices(every, k=n)) for n in (5, 30, 90, 400))]
    for t in texts:
        assert one(folding.fold_to_ascii, t) == "".join(c if c < "\x80" else folding.folded(c) for c in t)


def test_ratio_of_codes(monkeypatch):
    """Codes don't go through the general matcher, and get the same ratio."""
    import random
    from difflib import SequenceMatcher

    rnd = random.Random(5)
    pairs = [("".join(rnd.choices("ABCa", k=rnd.randint(0, 14))), "".join(rnd.choices("ABCb", k=rnd.randint(0, 14)))) for _ in range(4000)]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [metrics.ratio(a, b) for a, b in pairs] == want
    monkeypatch.setattr(metrics, "SequenceMatcher", None)
    metrics.ratio.cache_clear()
    assert repair.alike("KTMD", "KTND") == 0.75


def test_digit_runs_of_ascii_and_others():
    assert repair.digit_runs("a12 3\n045") == [(1, "12"), (4, "3"), (6, "045")]
    assert repair.digit_runs("a12 ३²x") == [(1, "12"), (4, "३²")]
    assert repair.digit_runs("") == []

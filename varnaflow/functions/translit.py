"""Romanized words to Devanagari by rule, as native Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, text

#: Consonants in matching order (fixed values).
CONSONANTS = {
    "gya": "ज्ञ", "ksh": "क्ष", "tr": "त्र",
    "kh": "ख", "gh": "घ", "ng": "ङ", "chh": "छ", "ch": "च", "jh": "झ", "ny": "ञ", "Th": "ठ", "Dh": "ढ", "th": "थ", "dh": "ध", "ph": "फ", "bh": "भ", "Sh": "ष", "sh": "श",
    "k": "क", "g": "ग", "c": "च", "j": "ज", "T": "ट", "D": "ड", "N": "ण", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व", "s": "स", "h": "ह", "f": "फ", "z": "ज",
}
#: Vowels with their own form and the sign after a consonant (fixed values).
VOWELS = {
    "aa": ("आ", "ा"), "A": ("आ", "ा"), "ii": ("ई", "ी"), "I": ("ई", "ी"), "ai": ("ऐ", "ै"), "au": ("औ", "ौ"), "uu": ("ऊ", "ू"), "U": ("ऊ", "ू"), "ri": ("ऋ", "ृ"),
    "e": ("ए", "े"), "o": ("ओ", "ो"), "i": ("इ", "ि"), "u": ("उ", "ु"), "a": ("अ", ""),
}
MARKS = {"n~~": "ँ", "n~": "ं", "m~": "ं", "H": "ः"}
VIRAMA = "्"
#: Whole words with a fixed form (fixed values).
ENGLISH_FORMS = {
    "computer": "कम्प्युटर", "school": "स्कुल", "office": "अफिस", "mobile": "मोबाइल", "internet": "इन्टरनेट", "facebook": "फेसबुक", "google": "गुगल", "project": "प्रोजेक्ट", "energy": "एनर्जी", "english": "इङ्ग्लिश",
}
ENGLISH_SPELLINGS = {
    "computer": "kampyutar", "school": "skul", "office": "ofis", "mobile": "mobail", "internet": "intarnet", "facebook": "fesbuk", "google": "gugal", "project": "prajekt", "energy": "enarji", "english": "inglish",
}
#: English spellings and how they sound, in order (fixed values).
ENGLISH_SOUNDS = (
    ("sch", "sk"), ("tion", "shan"), ("sion", "zhan"), ("ph", "f"), ("ck", "k"), ("qu", "ku"), ("wr", "r"), ("kn", "n"), ("wh", "w"), ("oo", "u"), ("ee", "i"), ("ai", "ai"), ("ay", "ei"), ("ei", "i"), ("ie", "i"), ("x", "ks"), ("c", "k"), ("q", "k"),
)

#: What is tried at each place, in order.
UNITS = [*MARKS, *(v for v in VOWELS if len(v) > 1), *CONSONANTS, *(v for v in VOWELS if len(v) == 1)]


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def prepared(c: Column) -> Column:
    """Lower case, but for ``T D N H`` and ``Sh``, which have sounds of their own."""
    # Shielded by private characters while the rest is lower-cased.
    shielded = F.translate(F.regexp_replace(text(c), "Sh", "h"), "TDNH", "")
    return F.translate(F.lower(shielded), "", "STDNH")


def units(c: Column) -> Column:
    """array<struct<t, v>>: C consonant, V vowel, AN anusvara, CB chandrabindu, VS visarga, SP anything else."""
    found = F.regexp_extract_all(text(c), F.lit(f"(?s)({'|'.join(UNITS)}|.)"), 1)
    kinds = _table({k: "C" for k in CONSONANTS} | {k: "V" for k in VOWELS} | {"n~~": "CB", "n~": "AN", "m~": "AN", "H": "VS"})
    return F.transform(found, lambda u: F.struct(F.coalesce(kinds[u], F.lit("SP")).alias("t"), u.alias("v")))


def written(tokens: Column) -> Column:
    """Devanagari of typed units; each unit's form depends on its neighbours' types only."""
    consonant, own, sign, mark = _table(CONSONANTS), _table({k: v[0] for k, v in VOWELS.items()}), _table({k: v[1] for k, v in VOWELS.items()}), _table(MARKS)

    def form(all_: Column, u: Column, i: Column) -> Column:
        before, after = F.get(all_, i - 1)["t"], F.get(all_, i + 1)["t"]
        return (
            F.when(u["t"] == "C", F.concat(consonant[u["v"]], F.when(after == "C", VIRAMA).otherwise("")))
            .when(u["t"] == "V", F.when((i > 0) & (before == "C"), sign[u["v"]]).otherwise(own[u["v"]]))
            .when(u["t"] == "SP", u["v"])
            .otherwise(mark[u["v"]])
        )

    return let(tokens, lambda all_: F.array_join(F.transform(all_, lambda u, i: form(all_, u, i)), ""))


#: Units of several letters as they are tried (a place that doesn't begin with two fitting letters is left at once), and a private character for each, by kinds.
_LONG = [u for u in UNITS if len(u) > 1]
_LONG_PATTERN = f"(?=[{''.join(sorted({u[0] for u in _LONG}))}][{''.join(sorted({u[1] for u in _LONG}))}])({'|'.join(_LONG)})"
_PRIVATE = {u: chr(first + i) for first, table in ((0xE100, CONSONANTS), (0xE140, VOWELS), (0xE180, MARKS)) for i, u in enumerate(x for x in table if len(x) > 1)}
_CONSONANT, _VOWEL = (f"[{''.join(x for x in table if len(x) == 1)}\\u{first:x}-\\u{first + 63:x}]" for first, table in ((0xE100, CONSONANTS), (0xE140, VOWELS)))
_OPEN, _CLOSE, _JOIN = "\ue1f0", "\ue1f1", "\ue1f2"


def _written_at_once(t: Column) -> Column:
    """``written(units(t))`` of a text without the private characters, by replacing strings: no step for each unit."""
    one = lambda u: _PRIVATE.get(u, u)
    out = F.regexp_replace(t, _LONG_PATTERN, f"{_OPEN}$1{_CLOSE}")
    for unit, char in _PRIVATE.items():
        out = F.replace(out, F.lit(f"{_OPEN}{unit}{_CLOSE}"), F.lit(char))
    out = F.regexp_replace(out, f"({_CONSONANT})(?={_CONSONANT})", f"$1{VIRAMA}")
    out = F.regexp_replace(out, f"({_CONSONANT})(?={_VOWEL})", f"$1{_JOIN}")
    forms = CONSONANTS | {v: own for v, (own, _) in VOWELS.items()} | MARKS
    single = {one(u): form for u, form in forms.items() if len(form) == 1}
    out = F.translate(out, "".join(single), "".join(single.values()))
    for unit, form in forms.items():
        if len(form) > 1:
            out = F.replace(out, F.lit(one(unit)), F.lit(form))
    for own, sign in dict(VOWELS.values()).items():
        out = F.replace(out, F.lit(_JOIN + own), F.lit(sign))
    return out


def transliterate(c: Column) -> Column:
    return let(prepared(c), lambda t: F.when(t.rlike("[\\ue100-\\ue1ff]"), written(units(t))).otherwise(_written_at_once(t)))


def english_spelling(word: Column) -> Column:
    """An English word spelled so that the rules above can read it."""
    out = F.replace(F.regexp_replace(F.lower(strip(text(word))), "[^a-z'-]+", ""), F.lit("-"), F.lit(""))
    sound = out
    for old, new in ENGLISH_SOUNDS:
        sound = F.replace(sound, F.lit(old), F.lit(new))
    return F.coalesce(_table(ENGLISH_SPELLINGS)[out], sound)


def english_to_devanagari(word: Column) -> Column:
    key = F.replace(F.regexp_replace(F.lower(strip(text(word))), "[^a-z'-]+", ""), F.lit("-"), F.lit(""))
    return F.coalesce(_table(ENGLISH_FORMS)[key], transliterate(english_spelling(word)))


def english_pairs(english: Column) -> Column:
    """array<struct<word, devanagari>> for an array of English words."""
    return F.transform(english, lambda w: F.struct(w.alias("word"), english_to_devanagari(w).alias("devanagari")))

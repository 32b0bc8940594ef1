"""The word functions of ``phonetic`` and ``translit`` for Python code that works inside a row.

Same tables, one word at a time; used where a row's result depends on the order of
its own steps, so that it can't be a Column expression.  Kept equal to the native
forms by tests.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .phonetic import DIGRAPHS, LENGTH, STEPS, SYMBOLS
from .translit import CONSONANTS, ENGLISH_FORMS, ENGLISH_SOUNDS, ENGLISH_SPELLINGS, MARKS, UNITS, VIRAMA, VOWELS

_UNIT = re.compile("(?s)" + "|".join(map(re.escape, UNITS)) + "|.")
_SOUND = re.compile("(?s)" + "|".join(DIGRAPHS) + "|.")
_FOLD = str.maketrans("āīūṁṃñṙ", "aiummnr")
_NOT_TOKEN = re.compile("[^A-Za-z0-9ऀ-ॿ']+")


@lru_cache(maxsize=1 << 17)
def clean(token: str) -> str:
    return _NOT_TOKEN.sub("", token)


def _coded(sounds: list[str], symbols: dict[str, str]) -> str:
    out = [s.upper() for s in sounds[:1] if s in "aeiou"]
    for s in sounds[len(out) :]:
        if s in "aeiou":
            continue
        heard = symbols.get(s) or symbols.get(s.lower()) or s.upper()
        if len(out) < LENGTH and out[-1:] != [heard]:
            out.append(heard)
    if sounds and sounds[-1] in "aeiou" and len(out) < LENGTH and out[-1:] != [sounds[-1].upper()]:
        out.append(sounds[-1].upper())
    return "".join(out)


@lru_cache(maxsize=1 << 17)
def key(word: str) -> str:
    """``phonetic_key`` of one word."""
    if len(word) == 2:
        spelled = word.upper()
    else:
        spelled = word.strip().lower().translate(_FOLD)
        for pattern, new in STEPS:
            spelled = re.sub(pattern, new, spelled)
        spelled = re.sub(r"(.)\1{2,}", r"\1\1", spelled)
    sounds = _SOUND.findall(spelled)
    return _coded(sounds, SYMBOLS) or _coded(sounds, SYMBOLS | {"X": "X"}) or word[:LENGTH]


def transliterated(roman: str) -> str:
    shielded = re.sub("Sh|[TDNH]", lambda m: chr(0xE000 + "STDNH".index(m[0][0])) + m[0][1:], roman).lower()
    units = _UNIT.findall("".join("STDNH"[ord(c) - 0xE000] if 0xE000 <= ord(c) < 0xE005 else c for c in shielded))
    out = []
    for i, u in enumerate(units):
        if u in CONSONANTS:
            out.append(CONSONANTS[u] + VIRAMA * (units[i + 1 : i + 2] != [] and units[i + 1] in CONSONANTS))
        elif u in VOWELS:
            out.append(VOWELS[u][i > 0 and units[i - 1] in CONSONANTS])
        else:
            out.append(MARKS.get(u, u))
    return "".join(out)


@lru_cache(maxsize=1 << 17)
def devanagari(word: str) -> str:
    """``english_to_devanagari`` of one word."""
    plain = re.sub("[^a-z']+", "", word.strip().lower())
    if plain in ENGLISH_FORMS:
        return ENGLISH_FORMS[plain]
    sound = plain
    for old, new in ENGLISH_SOUNDS:
        sound = sound.replace(old, new)
    return transliterated(ENGLISH_SPELLINGS.get(plain, sound))

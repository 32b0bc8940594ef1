"""Folding of any text to ASCII by a two-level table of code points.

The table has a page for every 256 code points, an entry for each of them, and is
built from rules over the Unicode character database: compatibility decomposition,
letters by their names, and short lists of fixed values where names don't say the
sound.  It goes into the plan as one constant; looking a character up is two steps
into arrays, whatever the size of the table.  ASCII texts don't touch it.

Letters without a rule (ideographs, whose readings are in no rule) stay as they are;
other characters without one, such as emojis, go.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Code points from here on have no page.
END = 0x1FB00

#: Letters whose name or shape doesn't give their value (fixed values).
_LETTERS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ŋ": "ng", "Ŋ": "NG", "ə": "@", "ı": "i", "ĸ": "k", "ŉ": "'n",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
    "ё": "io", "ђ": "dj", "є": "ie", "ѕ": "dz", "і": "i", "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "џ": "dzh", "ґ": "g", "й": "i",
}
#: Signs (fixed values).
_SIGNS = {
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": ",,", "‹": "<", "›": ">", "«": "<<", "»": ">>", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "--", "―": "--", "…": "...", "•": "*", "·": "*", "′": "'", "″": "''",
    "¡": "!", "¿": "?", "©": "(c)", "®": "(r)", "™": "(tm)", "°": "deg", "±": "+-", "×": "x", "÷": "/", "⁄": "/", "€": "EUR", "£": "PS", "¥": "Y=", "¢": "C/", "§": "SS", "¶": "P", "¬": "!", "¦": "|", "´": "'", "−": "-", " ": " ", " ": "\n", " ": "\n\n", "।": ".", "॥": "..",
}
_KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "zi": "ji", "sya": "sha", "n": "n"}
#: Scripts whose letters' names begin with their sound.
_BY_FIRST_SOUND = re.compile(r"(?:HEBREW|ARABIC|GEORGIAN|ARMENIAN|SYRIAC)(?: SMALL| CAPITAL)? LETTER (?:FINAL )?([A-Z]+)")
#: Scripts whose consonants are named with the vowel that they carry.
_INDIC = re.compile(r"(?:DEVANAGARI|BENGALI|GURMUKHI|GUJARATI|ORIYA|TAMIL|TELUGU|KANNADA|MALAYALAM) (LETTER|VOWEL SIGN|SIGN) (?:(?:SHORT|CANDRA|VOCALIC) )?([A-Z]+)$")
#: Characters that are looked up as they are, not by their parts.
_WHOLE = re.compile(rf"{_INDIC.pattern}|HANGUL SYLLABLE |(?:HIRAGANA|KATAKANA) LETTER ")
_INDIC_SIGNS = {"VIRAMA": "", "NUKTA": "", "ANUSVARA": "N", "CANDRABINDU": "N", "BINDI": "N", "VISARGA": "H", "AVAGRAHA": "'"}


def _of_letter(c: str) -> str | None:
    """The ASCII of one decomposed character; None without a rule."""
    if c < "\x80":
        return c
    lower = c.lower()
    if c in _SIGNS:
        return _SIGNS[c]
    name = unicodedata.name(c, "")
    if c in _LETTERS or lower in _LETTERS:
        return _LETTERS[c] if c in _LETTERS else _LETTERS[lower].capitalize()
    if unicodedata.digit(c, None) is not None:
        return str(unicodedata.digit(c))
    if m := re.match(r"LATIN (SMALL|CAPITAL|LETTER SMALL CAPITAL) LETTER (?:DOTLESS |LONG |OPEN |TURNED |REVERSED |SCRIPT )?([A-Z]{1,2})\b", name):
        return m[2] if m[1] == "CAPITAL" else m[2].lower()
    if name.startswith("HANGUL SYLLABLE "):
        return name[16:].lower()
    if m := re.match(r"(?:HIRAGANA|KATAKANA) LETTER (?:SMALL )?([A-Z]+)", name):
        return _KANA.get(m[1].lower(), m[1].lower())
    if m := _INDIC.match(name):
        kind, sound = m.groups()
        if kind == "SIGN":
            return _INDIC_SIGNS.get(sound)
        if "VOCALIC" in name:
            return sound
        return sound[:-1].lower() if kind == "LETTER" and len(sound) > 1 and sound.endswith("A") and sound[0] not in "AEIOU" else sound.lower()
    if m := _BY_FIRST_SOUND.match(name):
        sound = re.match(r"[^AEIOU]+|[AEIOU]", m[1])[0].lower()
        return sound.capitalize() if " CAPITAL " in name else sound
    return None


def folded(c: str) -> str:
    """The ASCII of a character; itself if it is a letter without a rule, nothing if it is anything else without one."""
    if c in _SIGNS or c in _LETTERS or c.lower() in _LETTERS or _WHOLE.match(unicodedata.name(c, "")):
        return _of_letter(c) or ""
    if unicodedata.category(c) == "Zs":
        return " "
    out = []
    for part in unicodedata.normalize("NFKD", c):
        if unicodedata.combining(part) or unicodedata.category(part) == "Mn":
            continue
        ascii_ = _of_letter(part)
        if ascii_ is None:
            if unicodedata.category(c).startswith("L"):
                return c
            continue
        out.append(ascii_)
    return "".join(out)


@lru_cache(maxsize=1)
def table() -> str:
    """The pages as JSON: null for a page where every letter stays."""
    pages: list[list[str] | None] = []
    for first in range(0, END, 256):
        chars = [chr(x) if not 0xD800 <= x < 0xE000 else "" for x in range(first, first + 256)]
        entries = ["" if c < "\x80" else folded(c) for c in chars]  # ASCII is never looked up
        pages.append(None if entries == chars else entries)
    return json.dumps(pages, ensure_ascii=False, separators=(",", ":"))


@lru_cache(maxsize=1)
def _single() -> tuple[str, str]:
    """Letters of all pages that become one character: most of what texts need, by one look at each character."""
    pairs = [(chr(256 * k + i), x) for k, page in enumerate(json.loads(table())) for i, x in enumerate(page or ()) if len(x) == 1 and x != chr(256 * k + i) and not 0xD800 <= 256 * k + i < 0xE000]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Different characters of a text that are replaced one by one; a text of more is gone through by its characters.
FEW = 48


def fold_to_ascii(c: Column) -> Column:
    """A text in ASCII; null stays null."""
    pages = F.from_json(F.lit(table()), "array<array<string>>")

    def entry(char: Column) -> Column:
        point = F.ascii(char)
        return F.get(F.get(pages, F.shiftright(point, 8)), point.bitwiseAND(255))

    def each(t: Column) -> Column:
        one = lambda char: F.when(F.ascii(char) < 128, char).otherwise(F.coalesce(entry(char), char))
        return F.array_join(F.transform(F.split(t, ""), one), "")

    def replaced(t: Column, chars: Column) -> Column:
        # entries are ASCII or the character itself, so the order of the replacements doesn't matter
        return F.aggregate(chars, t, lambda out, char: F.replace(out, char, F.coalesce(entry(char), char)))

    def rest(t: Column) -> Column:
        chars = F.array_distinct(F.regexp_extract_all(t, F.lit("([^\\x00-\\x7F])"), F.lit(1)))
        return F.when(t.rlike("[^\\x00-\\x7F]"), let(chars, lambda found: F.when(F.size(found) <= FEW, replaced(t, found)).otherwise(each(t)))).otherwise(t)

    return let(c, lambda t: F.when(t.rlike("[^\\x00-\\x7F]"), let(F.translate(t, *_single()), rest)).otherwise(t))

"""Putting English words and numerals back into transliterated sentences.

A row's repair depends on the order of its own replacements, so this is row-local
Python over Arrow batches; scores of word pairs are kept between rows.  The
default keeps the placement rules of published results even where they look odd:
a matched word is replaced where an equal token first stands, and the searched
places follow from the difference in length alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import ratio
from .wordmodel import clean, devanagari, key

#: Postpositions and their Devanagari form (fixed values).
MARKERS = {"ma": "मा", "maa": "मा", "le": "ले", "ko": "को", "lai": "लाई", "sanga": "सँग", "bata": "बाट", "pachi": "पछि", "samma": "सम्म", "bhitra": "भित्र", "ta": "ता", "nai": "नै"}
#: Words that lean on the one before (fixed values).
TAILS = frozenset("ma maa ko lai le bata sanga atha pani ta nai ra tah मा को लाई ले बाट सँग अथ पनि त नै र तह".split())
#: Usual forms of some English words (fixed values).
USUAL_FORMS = {"new": ["न्यु", "न्यू"], "job": ["जब", "जॉब"], "office": ["अफिस", "ऑफिस"], "phone": ["फोन"], "movie": ["मुभी", "मूभी"], "video": ["भिडियो", "विडियो"], "friend": ["फ्रेन्ड", "फ्रेंड"]}
LEAST_SCORE = 0.30
LEAST_USUAL = 0.10
_DIGITS = re.compile("[0-9]+")
DIGITS = str.maketrans("0123456789", "०१२३४५६७८९")
#: Longest form first; of equally long ones, in table order.
SUFFIXES = sorted(MARKERS.items(), key=lambda kv: -len(kv[1]))

RESULT = "text string, replacements array<struct<roman_word:string,target_word:string,score:double,target_index:int,kind:string,context_score:double>>"


def attached_marker(token: str) -> str | None:
    """The marker that a longer Devanagari word ends in."""
    word = clean(token)
    return next((m for m, form in SUFFIXES if word.endswith(form) and len(word) > len(form)), None)


def marker_form(token: str) -> str:
    return MARKERS.get(clean(token).lower(), token)


def alike(a: str, b: str) -> float:
    return ratio(a, b) if a and b else 0.0


def length_score(source: str, target: str) -> float:
    r = max(1, len(clean(target))) / max(1, len(clean(source)))
    return max(0.0, 1 - abs(r - 1) / 1.25) if 0.5 <= r <= 2.25 else 0.0


@lru_cache(maxsize=1 << 17)
def pair_score(roman: str, deva: str) -> float:
    """0.7 sound and 0.3 length of a romanized word and a Devanagari token."""
    return 0.7 * alike(key(devanagari(roman)), key(deva)) + 0.3 * length_score(roman, deva) if roman and deva else 0.0


def window_score(roman: list[str], deva: list[str]) -> float:
    """Mean of the pairs; zero for windows of different length."""
    return sum(map(pair_score, roman, deva)) / len(roman) if roman and len(roman) == len(deva) else 0.0


def _tail(token: str) -> bool:
    return token.lower() in TAILS


def _deva_number(token: str) -> bool:
    return any("०" <= c <= "९" for c in token)


def _places(i: int, n_in: int, n_out: int) -> range:
    """Target places tried for source place ``i``."""
    surplus = n_in - n_out
    return range(max(0, i - 2 * surplus - 1), min(n_out, i + 2))


def _best(scored: Iterable[tuple[float, str]]) -> tuple[str | None, float]:
    """The first of the highest."""
    word, high = None, -1.0
    for score, token in scored:
        if score > high:
            word, high = token, score
    return word, high


def english_match(word: str, roman: list[str], deva: list[str], i: int) -> tuple[str | None, float]:
    """The target token whose surroundings sound most like those of the English word at ``i``."""
    after = roman[i + 1 : i + 2]
    if after and _tail(after[0]) and i + 2 < len(roman):
        after = [roman[i + 2]]
    window = [*roman[max(0, i - 1) : i], word, *after]
    middle = min(i, 1)
    fits = (deva[s : s + len(window)] for s in _places(i, len(roman), len(deva)) if s + len(window) <= len(deva))
    return _best((window_score(window, d), d[middle]) for d in fits if not _tail(d[middle]))


def number_match(roman: list[str], deva: list[str], i: int) -> tuple[str | None, float]:
    """The target token between tokens that sound like the number's neighbours."""
    if i == 0:
        return (deva[0], 1.0) if deva else (None, -1.0)
    if i + 1 >= len(roman):
        return None, -1.0
    scored = []
    for c in _places(i, len(roman), len(deva)):
        if c and not _deva_number(deva[c]) and not _tail(deva[c]):
            parts = [pair_score(roman[i - 1], deva[c - 1])] + [pair_score(roman[i + 1], d) for d in deva[c + 1 : c + 2]]
            scored.append((sum(parts) / len(parts), deva[c]))
    return _best(scored)


@dataclass
class Sentence:
    """A pair under repair."""

    roman: list[str]
    raw: list[str]
    deva: list[str] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    used: set[int] = field(default_factory=set)
    put: dict[int, str] = field(default_factory=dict)
    log: list[tuple] = field(default_factory=list)

    @classmethod
    def of(cls, roman: str, deva: str) -> Sentence:
        out = cls([t.lower() for x in roman.split() if (t := clean(x))], deva.split())
        for n, token in enumerate(out.raw):
            if word := clean(token):
                out.deva.append(word)
                out.place.append(n)
        return out

    def claim(self, token: str | None) -> int | None:
        """The first place of an equal token, if it is still free."""
        at = self.deva.index(token) if token in self.deva else None
        if at is None or at in self.used:
            return None
        self.used.add(at)
        return at

    def text(self) -> str:
        return " ".join(self.put.get(n, t) for n, t in enumerate(self.raw))


def _numbers(s: Sentence) -> None:
    for i, word in enumerate(s.roman):
        if word.isdigit():
            token, score = number_match(s.roman, s.deva, i)
            at = s.claim(token)
            if at is not None:
                s.deva[at] = s.put[s.place[at]] = word.translate(DIGITS)
                s.log.append((word, s.deva[at], score, s.place[at], "number", 0.0))


def _english(s: Sentence, vocabulary: frozenset[str], least: float) -> None:
    for i, word in enumerate(s.roman):
        if word not in vocabulary or word in MARKERS or word.isdigit():
            continue
        token, score = english_match(word, s.roman, s.deva, i)
        at = s.claim(token) if score >= least else None
        if at is None:
            continue
        after = s.roman[i + 1] if i + 1 < len(s.roman) else None
        marker = attached_marker(token)
        if marker and after == marker:
            s.put[s.place[at]] = f"{word} {MARKERS[marker]}"
            s.log.append((word, f"{word} + {MARKERS[marker]}", score, s.place[at], "english+marker", score))
            continue
        s.put[s.place[at]] = word
        s.log.append((word, word, score, s.place[at], "english", score))
        follows = at + 1
        if after in MARKERS and follows < len(s.deva) and follows not in s.used and s.deva[follows] == MARKERS[after]:
            s.used.add(follows)
            s.put[s.place[follows]] = MARKERS[after]
            s.log.append((after, MARKERS[after], 0.0, s.place[follows], "marker", 0.0))


def rebuild(roman: str, deva: str, vocabulary: frozenset[str], least: float = LEAST_SCORE) -> tuple[str, list[tuple]]:
    """Numbers first, then English words against the tokens as the numbers left them."""
    s = Sentence.of(roman, deva)
    if not s.deva:
        return deva, []
    _numbers(s)
    _english(s, vocabulary, least)
    return s.text(), s.log


def digit_runs(sentence: str) -> list[tuple[int, str]]:
    """(first character, digits) of each run."""
    if sentence.isascii():
        return [(m.start(), m[0]) for m in _DIGITS.finditer(sentence)]
    out: list[tuple[int, str]] = []
    for n, c in enumerate(sentence):
        if c.isdigit():
            if out and out[-1][0] + len(out[-1][1]) == n:
                out[-1] = (out[-1][0], out[-1][1] + c)
            else:
                out.append((n, c))
    return out


def number_place(s: Sentence, i: int) -> int | None:
    """The raw target place whose neighbours' codes are most like those of source place ``i``."""
    before, after = (s.roman[i - 1] if i > 0 else None), (s.roman[i + 1] if i + 1 < len(s.roman) else None)
    best, high = None, -1.0
    for d in range(len(s.deva)):
        near = [(before, s.deva[d - 1])] if before and d else []
        near += [(after, s.deva[d + 1])] if after and d + 1 < len(s.deva) else []
        good = [x for a, b in near if (x := alike(key(a), key(b))) > LEAST_SCORE]
        if good and sum(good) / len(good) > high:
            best, high = d, sum(good) / len(good)
    return None if best is None else s.place[best]


def place_numbers(roman: str, deva: str, log: list[tuple]) -> tuple[str, list[tuple]]:
    """Second pass over numbers; a number's token is counted by the white space before it."""
    numbers = digit_runs(roman)
    if not numbers:
        return deva, log
    s, more = Sentence.of(roman, deva), []
    for at, digits in numbers:
        i = sum(c.isspace() for c in roman[: at + 1])
        found = number_place(s, i) if i < len(s.roman) else None
        if found is not None:
            s.put[found] = digits.translate(DIGITS)
            more.append((digits, digits.translate(DIGITS), 1.0, found, "number", 0.0))
    return s.text(), log + more


def repaired(roman: str, deva: str, vocabulary: frozenset[str], least: float = LEAST_SCORE, second_pass: bool = True) -> tuple[str, list[tuple]]:
    out, log = rebuild(roman, deva, vocabulary, least)
    return place_numbers(roman, out, log) if second_pass else (out, log)


_FIELDS = [("roman_word", pa.string()), ("target_word", pa.string()), ("score", pa.float64()), ("target_index", pa.int32()), ("kind", pa.string()), ("context_score", pa.float64())]


def repair(frame: DataFrame, roman: str, deva: str, vocabulary: Iterable[str], least: float = LEAST_SCORE, second_pass: bool = True) -> DataFrame:
    """``frame`` with ``text`` and ``replacements`` of each pair; null counts as empty.

    ``vocabulary`` is a bounded list of English words, sent to the workers once a
    task.  Batches pass through Arrow with their other columns untouched.
    """
    known = frozenset(vocabulary)
    kind = pa.list_(pa.struct(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [repaired(a or "", b or "", known, least, second_pass) for a, b in zip(batch.column(roman).to_pylist(), batch.column(deva).to_pylist(), strict=True)]
            logs = [[dict(zip((n for n, _ in _FIELDS), r, strict=True)) for r in log] for _, log in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t for t, _ in rows], pa.string()), pa.array(logs, kind)], [*batch.schema.names, "text", "replacements"])

    added = T._parse_datatype_string(RESULT)
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *added.fields]))


def replacement_lines(replacements: Column) -> Column:
    """One line for each replacement."""
    return F.transform(replacements, lambda r: F.format_string("- %s -> %s (score=%.4f, index=%d, kind=%s, context=%.4f)", r["roman_word"], r["target_word"], r["score"], r["target_index"], r["kind"], r["context_score"]))


# Earlier matchers, kept for callers that compare them ------------------------------


def neighbours_score(roman: list[str], deva: list[str], i: int, j: int, width: int = 1) -> float:
    """Mean likeness of the tokens around two places; 1 without any."""
    near = [(i + o, j + o) for o in [*range(-1, -width - 1, -1), *range(1, width + 1)]]
    scores = [alike(key(roman[a]), key(deva[b])) for a, b in near if 0 <= a < len(roman) and 0 <= b < len(deva) and roman[a] and deva[b]]
    return sum(scores) / len(scores) if scores else 1.0


def offset_match(word: str, roman: list[str], deva: list[str], i: int) -> tuple[str | None, float]:
    """The best target token over all offsets up to the difference in length and one more."""
    reach = abs(len(roman) - len(deva)) + 1
    word_out, high = None, -1.0
    for o in range(-reach, reach + 1):
        before, here, after = i - 1 + o, i + o, i + 1 + o
        if not 0 <= here < len(deva) or i > 0 and not 0 <= before < len(deva):
            continue
        pairs = [(key(roman[i - 1]), roman[i - 1], deva[before])] if i > 0 else []
        pairs.append((key(devanagari(word)), word, deva[here]))
        if i + 1 < len(roman) and after < len(deva):
            pairs.append((key(roman[i + 1]), roman[i + 1], deva[after]))
        score = 0.7 * sum(alike(k, key(d)) for k, _, d in pairs) / len(pairs) + 0.3 * sum(length_score(r, d) for _, r, d in pairs) / len(pairs)
        if score > high:
            word_out, high = deva[here], score
    return word_out, high


def target_match(word: str, targets: list[str], roman: list[str], i: int) -> tuple[str | None, float, float]:
    """(token, score, own likeness) of the best target by the mean of both neighbours and itself.

    Tokens of an impossible length are left out, but for the usual forms of some
    words, which only have to score ``LEAST_USUAL``.
    """
    own = key(devanagari(word))
    usual = USUAL_FORMS.get(word.lower(), [])

    def scored(j: int, token: str) -> tuple[float, float]:
        raw = alike(own, key(token))
        parts = [raw]
        if i > 0 and j > 0 and roman[i - 1] and targets[j - 1]:
            parts.append(alike(key(roman[i - 1]), key(targets[j - 1])))
        if i + 1 < len(roman) and j + 1 < len(targets) and roman[i + 1] and targets[j + 1]:
            parts.append(alike(key(roman[i + 1]), key(targets[j + 1])))
        return sum(parts) / len(parts), raw

    found: tuple[str | None, float, float] = (None, -1.0, -1.0)
    tokens = [(j, clean(t)) for j, t in enumerate(targets) if clean(t)]
    for fits, least in ((lambda t: 0.5 <= len(t) / max(1, len(clean(word))) <= 2.25, -1.0), (usual.__contains__, LEAST_USUAL)):
        for j, token in tokens:
            if fits(token):
                score, raw = scored(j, token)
                if score >= least and score > found[1]:
                    found = (token, score, raw)
    return found


_MATCH = ("place int", "word string", "by_offset string", "offset_score double", "by_target string", "target_score double", "own_score double", "around double", "marker string")


def earlier_matches(roman: str, deva: str, vocabulary: frozenset[str]) -> list[tuple]:
    """One row for each English word of a sentence: the choices of the earlier matchers, and the marker of the chosen token."""
    s, out = Sentence.of(roman, deva), []
    for i, word in enumerate(s.roman):
        if word in vocabulary and s.deva:
            token, score = offset_match(word, s.roman, s.deva, i)
            other, mean, own = target_match(word, s.deva, s.roman, i)
            around = neighbours_score(s.roman, s.deva, i, min(i, len(s.deva) - 1))
            out.append((i, word, token, score, other, mean, own, around, attached_marker(token or "")))
    return out


def matched_words(frame: DataFrame, roman: str, deva: str, vocabulary: Iterable[str]) -> DataFrame:
    """``frame`` with one row for each English word and its ``m``, a struct of ``earlier_matches``; null counts as empty."""
    known = frozenset(vocabulary)

    names = [field.split(" ")[0] for field in _MATCH]

    @F.pandas_udf(f"array<struct<{', '.join(field.replace(' ', ': ') for field in _MATCH)}>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r, strict=True)) for r in earlier_matches(x or "", y or "", known)] for x, y in zip(a, b, strict=True)], dtype=object)

    return frame.select("*", F.explode(run(F.col(roman), F.col(deva))).alias("m"))

"""Personal data, with offset-preserving deobfuscation.

Base identifiers are found in the text as it is.  Then transducers rewrite a text
that has a disguise in it: look-alike characters, digits spelled as words, and
at/dot disguises.  Each rewritten piece remembers the source range it came from,
so an identifier found in the rewritten text maps back to source characters.
An added span counts only if rewriting changed it and no base span of its kind
holds it; base spans always stay.

All scans are linear in the text, so very long texts and words are safe: local
parts are read backwards from each ``@``, digit runs are matched possessively, the
white space around a sign is read outward from the sign, and spans are compared in
one sweep by start.
Row-local: no shuffle, nothing is kept between rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers as written, by kind and start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") for x in m[0].split(".")]
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


# Transducers -----------------------------------------------------------------

#: Look-alikes that compatibility folding does not reach (fixed values).
_CONFUSABLE = dict(
    zip(
        "аеорсухіјѕԁԛԝАВЕКМНОРСТХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡոսо۔。،‐‑‒–—−﹣＠﹫＋﹢",
        "aeopcyxijsdqwABEKMHOPCTXIJSaeiknoptuxABEZHIKMNOPTYXignuo..,-------@@++",
        strict=True,
    )
)
_OPENING = frozenset("[({<")
_INVISIBLE = frozenset("­​‌‍⁠﻿")
_SPELLED = {
    word: str(value)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for value, word in enumerate(words.split())
}
_AT_WORDS = "at|arroba|arobase"
_DOT_WORDS = "dot|punkt|punto"
#: Last labels that a fully spelled address ("x at y dot z") may end in whatever stands before (fixed values).
_LAST_LABELS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv de fr es uk us eu it nl ch at be ca au in jp cn br ru pl se no dk fi ie pt mx ar np example test".split())
#: Words that open a phrase of prose after "at", and words that go on after "dot" (fixed values).
_ARTICLES = frozenset("the a an this that these those each every my your our his her its their one no some any der die das den dem des ein eine einen einem le la les un une el los las una".split())
_PROSE = frozenset("on in of to and or is was are were for with from by as at the a an that which where when but not it he she they we you und oder ist auf im von zu et ou est sur dans y o en por para".split())
#: An at or dot sign without the white space around it, which ``_signs`` reads.
_AT = re.compile(rf"@|[\[({{<][ \t]*+(?:{_AT_WORDS}|@)[ \t]*+[\])}}>]|(?<=[ \t\n])(?:{_AT_WORDS})(?=[ \t\n])", re.I)
_DOT_SIGN = re.compile(rf"\.|[\[({{<][ \t]*+(?:{_DOT_WORDS}|point|\.)[ \t]*+[\])}}>]|(?<=[ \t\n])(?:{_DOT_WORDS})(?=[ \t\n])", re.I)
#: The same for a place right after a label, where white space is tried once.
_DOT = rf"(?:\.|[ \t]*+[\[({{<][ \t]*+(?:{_DOT_WORDS}|point|\.)[ \t]*+[\])}}>][ \t]*+|[ \t\n]++(?:{_DOT_WORDS})[ \t\n]++)"
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I)
_BRACKETED_DOT = rf"[ \t]*+[\[({{<][ \t]*+(?:{_DOT_WORDS}|point|\.)[ \t]*+[\])}}>][ \t]*+"
#: Four numbers with a bracketed dot between some of them.
_DOTTED = re.compile(rf"(?<![0-9])[0-9]++(?:(?:\.|{_BRACKETED_DOT})[0-9]++){{3}}", re.I)
_DOT_BETWEEN = re.compile(_BRACKETED_DOT, re.I)
_TOKEN = re.compile(r"[^\W_]+|\+")
_GAP = re.compile(r"[ \t\n,.()-]{0,3}")
_WORD_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPELLED_UTF8 = frozenset(w.encode() for w in _SPELLED)
_DOTS_UTF8 = frozenset(w.encode() for w in _DOT_WORDS.split("|"))
#: Fewer spelled digits than this in a run are ordinary words.
SPELLED_RUN = 3


@lru_cache(maxsize=4096)
def _plain(c: str) -> str | None:
    """What a look-alike stands for: one ASCII character, nothing if invisible; None for all others."""
    if c in _INVISIBLE:
        return ""
    if c in _CONFUSABLE:
        return _CONFUSABLE[c]
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else None


class Mapped:
    """A rewritten text; ``source`` maps a span of it back to the original."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str | None]]) -> None:
        """pieces: (start, end, output) in order; output None stands for the source as it is."""
        self.starts: list[int] = []
        self.pieces: list[tuple[int, int, bool]] = []
        parts, at = [], 0
        for start, end, output in pieces:
            part = text[start:end] if output is None else output
            if part:
                self.starts.append(at)
                self.pieces.append((start, end, output is None))
                parts.append(part)
                at += len(part)
        self.text = "".join(parts)

    def source(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, b = self.pieces[i], self.pieces[j]
        return (a[0] + start - self.starts[i] if a[2] else a[0]), (b[0] + end - self.starts[j] if b[2] else b[1])


def _homoglyphs(text: str) -> Mapped | None:
    found = {c: p for c in set(text) if c > "\x7f" and (p := _plain(c)) is not None}
    if not found:
        return None
    pieces, at = [], 0
    for m in re.finditer("[" + "".join(map(re.escape, found)) + "]", text):
        pieces += [(at, m.start(), None), (m.start(), m.end(), found[m[0]])]
        at = m.end()
    return Mapped(text, [*pieces, (at, len(text), None)])


def _signs(sign: re.Pattern, text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, first character) of at or dot signs, white space around disguised ones included.

    A spelled sign needs white space of its own on both sides: what an earlier sign
    took is gone.
    """
    done = start
    for m in sign.finditer(text, start, end):
        a, b = m.span()
        if a < done:
            continue
        first = text[a]
        if first not in "@.":
            white = " \t" if first in _OPENING else " \t\n"
            while a > done and text[a - 1] in white:
                a -= 1
            while b < end and text[b] in white:
                b += 1
            if first not in _OPENING and (a == m.start() or b == m.end()):
                continue
        done = b
        yield a, b, first


def _at_dot(text: str) -> list[tuple[int, int, str]]:
    """Replacements inside e-mail addresses that have a disguised at or dot."""
    out: list[tuple[int, int, str]] = []
    done, dot_before = 0, None
    for at_start, at_end, first in _signs(_AT, text, 0, len(text)):
        host = _HOST.match(text, at_end) if at_start >= done else None
        if not host:
            continue
        if dot_before is None:  # where each disguised dot begins, by its end
            dot_before = {b: a for a, b, sign in _signs(_DOT_SIGN, text, 0, len(text)) if sign != "."}
        start, dots = at_start, []
        while start > done:  # the local part, read backwards over disguised dots
            if text[start - 1] in _LOCAL:
                start -= 1
            elif start < at_start and (at := dot_before.get(start, -1)) > done and text[at - 1] in _LOCAL:
                dots.append((at, start))
                start = at
            else:
                break
        if start == at_start:
            continue
        host_dots = [(a, b) for a, b, sign in _signs(_DOT_SIGN, text, host.start(), host.end()) if sign != "."]
        if first not in _OPENING and first != "@" and not _spelled_host(re.split(r"[^A-Za-z0-9-]+", host[0]), len(host_dots)):
            continue
        if first in _OPENING or host_dots or first == "@" and dots:
            out += [(*d, ".") for d in dots] + [(at_start, at_end, "@")] * (first != "@") + [(*d, ".") for d in host_dots]
            done = host.end()
    return out


def _spelled_host(labels: list[str], dots: int) -> bool:
    """Whether a host with spelled dots after a spelled at is one: by its last label, or unless it reads as prose."""
    first, last = labels[0].lower(), labels[-1].lower()
    return last in _LAST_LABELS and first not in _ARTICLES or dots > 1 and last.isalpha() or len(last) > 1 and last.isalpha() and first not in _ARTICLES and last not in _PROSE


def _dotted_numbers(text: str) -> list[tuple[int, int, str]]:
    """Replacements of bracketed dots between four numbers."""
    return [(*d.span(), ".") for m in _DOTTED.finditer(text) for d in _DOT_BETWEEN.finditer(text, m.start(), m.end())]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Replacements for runs of spelled digits, with plus and dot words and numbers between."""
    out: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []
    words = 0
    spelled = 0

    def close() -> None:
        while run and run[-1][2] in ("+", "."):
            run.pop()
        if spelled >= SPELLED_RUN or words >= 3 and run:
            last = None
            for start, end, output in run:
                if last is not None and last < start:
                    between = text[last:start].strip()
                    out.append((last, start, "." if between == "." else ""))
                out.append((start, end, output))
                last = end

    for m in _TOKEN.finditer(text):
        word = m[0].lower()
        digit = _SPELLED.get(word)
        kind = digit or ("+" if word in ("+", "plus") else "." if word in ("dot", "punkt", "punto") else word if word.isascii() and word.isdigit() else None)
        joined = run and kind not in (None, "+") and _GAP.fullmatch(text, run[-1][1], m.start())
        if not joined:
            close()
            run, words, spelled = [], 0, 0
        if kind is not None and (run or kind != "."):
            run.append((*m.span(), kind))
            spelled += digit is not None
            words += kind == "."
    close()
    return out


def _rewritten(text: str, changes: list[tuple[int, int, str]]) -> Mapped:
    pieces, at = [], 0
    for start, end, output in sorted(changes):
        if start >= at:
            pieces += [(at, start, None), (start, end, output)]
            at = end
    return Mapped(text, [*pieces, (at, len(text), None)])


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that only the transducers show."""
    steps = []
    folded = None if text.isascii() else _homoglyphs(text)
    plain = text
    if folded:
        steps.append(folded)
        plain = folded.text
    words = plain.encode("utf-8", "replace").translate(_WORD_TABLE).split()
    changes = _at_dot(plain)
    if any(c in plain for c in "[({<"):
        changes = [*changes, *_dotted_numbers(plain)]
    if sum(map(_SPELLED_UTF8.__contains__, words)) >= SPELLED_RUN or sum(map(_DOTS_UTF8.__contains__, words)) >= 3:
        changes = [*changes, *_spelled(plain)]
    if changes:
        steps.append(_rewritten(plain, changes))
    if not steps:
        return []
    held, out = _Held(base), set()
    for depth in range(len(steps)):  # a folded text counts by itself too
        last = steps[depth].text
        for kind, a, b in base_spans(last):
            start, end = a, b
            for step in reversed(steps[: depth + 1]):
                start, end = step.source(start, end)
            if text[start:end] != last[a:b] and not held.any(kind, start, end):
                out.add((kind, start, end))
    kept, furthest = [], ("", -1)
    for kind, start, end in sorted(out, key=lambda x: (x[0], x[1], -x[2])):  # whatever holds a span comes before it
        if furthest[0] != kind or furthest[1] < end:
            kept.append((kind, start, end))
            furthest = (kind, end)
    return kept


class _Held:
    """Whether a span lies within one of some given spans of its kind."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        self.of: dict[str, tuple[list[int], list[int]]] = {}
        for kind, start, end in sorted(spans):
            starts, ends = self.of.setdefault(kind, ([], []))
            starts.append(start)
            ends.append(max(end, ends[-1]) if ends else end)

    def any(self, kind: str, start: int, end: int) -> bool:
        starts, ends = self.of.get(kind, ((), ()))
        i = bisect_right(starts, start)
        return i > 0 and ends[i - 1] >= end


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_<kind> over all spans, base and all spans as text.

    A null or empty text has no spans; long texts are read whole.  Rows with a null
    or repeated doc_id are documents of their own; other columns of ``docs`` are not
    read.  Where rewriting shows one identifier inside another of its kind, the
    longer counts.  An empty table gives no rows.
    """

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "text"):
                columns: list[list] = [[] for _ in range(7)]
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    base = base_spans(text)
                    spans = base + added_spans(text, base)
                    for c, x in zip(columns, (doc_id, *(sum(s[0] == k for s in spans) for k in KINDS), _joined(base), _joined(spans)), strict=True):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 5, pa.string(), pa.string()], strict=True)], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return texts(docs).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def masked(text: Column) -> Column:
    """The text with each identifier replaced by its kind in angle brackets; null stays null, empty stays empty.

    Where identifiers overlap, the first, of equally early ones the longest, names
    the whole stretch.
    """

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        parts = batches_by_bytes(pa.RecordBatch.from_arrays([column], ["text"]), "text")
        done = [pa.array([t if t is None else mask_text(t) for t in part.column("text").to_pylist()], pa.string()) for part in parts]
        return pa.concat_arrays([*done, pa.array([], pa.string())])

    return mask(text)


def mask_text(text: str) -> str:
    base = base_spans(text)
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(base + added_spans(text, base), key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"<{kind}>"]
        at = e
    return "".join([*out, text[at:]])

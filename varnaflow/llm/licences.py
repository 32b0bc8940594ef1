"""Licence scan by sentence rules.

A text is cut into sentences; a sentence is normalised (lower case, letters,
digits and single spaces only) and looked up among known licence sentences, each
given as a pattern of the whole normalised sentence.  Every document so becomes a
sequence of sentence identifiers in text order; ordered licence rules are matched
against it, longest rule first, each identifier explained by one rule only.  Other
known sentences may stand between those of a rule, ``GAP`` at most.  Identifiers that
no rule explains are reported as they are, never dropped.

Beside the sentences written out, templates around the names of licences give some two
hundred more: titles, "licensed under", "MIT licensed", ``License:`` lines.  The
expression of an SPDX tag or a ``License:`` line gives an identifier for each licence
in it, in order; one with an exception is a licence of its own.

Row-local and linear in the text.  With the sentences given here, only those that
have one of the words that each of them needs are normalised; with a caller's own,
all are.  Rules and sentences are parameters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_by_bytes, texts

#: identifier: pattern of the whole normalised sentence (fixed values, from the public licence texts)
SENTENCES = {
    "Apache2Licensed": r"(this (work|file|software|project) is )?(licensed|released|distributed|available) under the( terms of the)? apache( software)? licen[sc]e version 2( 0)?( the license)?",
    "Apache2Use": r"you may not use this file except in compliance with the license",
    "Apache2Copy": r"you may obtain a copy of the license at( https? www apache org licenses license 2 0)?",
    "Apache2Unless": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "Apache2See": r"see the license for the specific language governing permissions and limitations under the license",
    "MitLicensed": r"(this (work|file|software|project) is )?(licensed|released|distributed|available) under the( terms of the)? (mit|expat|mit expat) licen[sc]e",
    "MitPermission": r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction .* subject to the following conditions",
    "MitNotice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": r"the software is provided as is without warranty of any kind express or implied( .*)?",
    "IscPermission": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*",
    "BsdLicensed": r"(this (work|file|software|project) is )?(licensed|released|distributed|available) under the( terms of the)?( new| simplified| modified| revised)? (bsd|2 clause bsd|3 clause bsd|bsd [23] clause)( style)? licen[sc]e",
    "BsdRedistribution": r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": r"(1 )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": r"(2 )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdEndorse": r"(3 )?neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": r"this software is provided by .* as is and any express or implied warranties .*",
    "Gpl3Licensed": r"(this (work|file|software|project|program) is )?(licensed|released|distributed|available) under the( terms of the)? gnu general public licen[sc]e (version 3|v3)( 0)?",
    "Gpl2Licensed": r"(this (work|file|software|project|program) is )?(licensed|released|distributed|available) under the( terms of the)? gnu general public licen[sc]e (version 2|v2)( 0)?",
    "GplFree": r"this program is free software( you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation.*)?",
    "GplVersion3": r".*either version 3 of the license or at your option any later version",
    "GplVersion2": r".*either version 2 of the license or at your option any later version",
    "GplHope": r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": r"see the gnu general public license for more details",
    "Agpl3Licensed": r"(this (work|file|software|project|program) is )?(licensed|released|distributed|available) under the( terms of the)? gnu affero general public licen[sc]e (version 3|v3)( 0)?",
    "Lgpl21Licensed": r"(this (work|file|software|project|library) is )?(licensed|released|distributed|available) under the( terms of the)? gnu lesser general public licen[sc]e (version |v)2 1",
    "Lgpl3Licensed": r"(this (work|file|software|project|library) is )?(licensed|released|distributed|available) under the( terms of the)? gnu lesser general public licen[sc]e (version |v)3( 0)?",
    "LgplLicensed": r"(this (work|file|software|project|library) is )?(licensed|released|distributed|available) under the( terms of the)? gnu (lesser|library) general public licen[sc]e.*",
    "Mpl2Licensed": r"this source code form is subject to the terms of the mozilla public license v 2 0|(licensed|released) under the mozilla public license (version|v) ?2( 0)?",
    "Epl2Licensed": r"(this program and the accompanying materials are )?(made )?available under the terms of the eclipse public license (version |v )?2 0.*",
    "ZlibPermission": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "ZlibAsIs": r"this software is provided as is without any express or implied warranty",
    "BoostLicensed": r"(licensed|released|distributed) under the( terms of the)? boost software license version 1 0.*",
    "WtfplLicensed": r"(licensed|released|distributed) under the( terms of the)? do what the fuck you want to public license( version 2)?",
    "Artistic2Licensed": r"(this (work|file|software|project|program) is )?(licensed|released|distributed|available) under the( terms of the)? artistic license (version )?2 0",
    "CcByLicensed": r"(this (work|text|page) is )?(licensed|released|available) under( a| the)? (cc by|creative commons attribution)( license)?( [1-4] 0)?( international)?( license)?",
    "CcByScLicensed": r"(this (work|text|page) is )?(licensed|released|available) under( a| the)? (cc by sa|creative commons attribution share ?alike)( license)?( [1-4] 0)?( international)?( license)?",
    "CcByNcLicensed": r"(this (work|text|page) is )?(licensed|released|available) under( a| the)? (cc by nc|creative commons attribution non ?commercial)( license)?( [1-4] 0)?( international)?( license)?",
    "CcByNcSaLicensed": r"(this (work|text|page) is )?(licensed|released|available) under( a| the)? (cc by nc sa|creative commons attribution non ?commercial share ?alike)( license)?( [1-4] 0)?( international)?( license)?",
    "Cc0Licensed": r".*(cc0 1 0 universal|dedicated to the public domain).*",
    "Unlicense": r"this is free and unencumbered software released into the public domain",
    "Copyright": r"(copyright|c) (c )?[0-9]{4}.*|copyright .*all rights reserved",
    **{f"Spdx{name}": rf"spdx license identifier {tag}" for name, tag in (
        ("Apache2", "apache 2 0"), ("Mit", "mit"), ("Isc", "isc"), ("Bsd3", "bsd 3 clause"), ("Bsd2", "bsd 2 clause"),
        ("Gpl3Later", "gpl 3 0 or later"), ("Gpl2Later", "gpl 2 0 or later"), ("Gpl3", "gpl 3 0( only)?"), ("Gpl2", "gpl 2 0( only)?"), ("Agpl3", "agpl 3 0( only| or later)?"), ("Lgpl21", "lgpl 2 1( only| or later)?"), ("Lgpl3", "lgpl 3 0( only| or later)?"), ("Lgpl", "lgpl [0-9] [0-9]( only| or later)?"),
        ("Epl2", "epl 2 0"), ("Zlib", "zlib"), ("Bsl1", "bsl 1 0"), ("Wtfpl", "wtfpl"), ("Artistic2", "artistic 2 0"),
        ("Mpl2", "mpl 2 0"), ("CcBy", "cc by [1-4] 0"), ("CcBySa", "cc by sa [1-4] 0"), ("CcByNc", "cc by nc [1-4] 0"), ("CcByNcSa", "cc by nc sa [1-4] 0"), ("Cc0", "cc0 1 0"), ("Unlicense", "unlicense"),
    )},
    "SpdxTag": r"spdx license identifier [a-z0-9 ]+",
}
#: licence: sentence identifiers in order; of rules that match at a place the one that explains most wins
RULES = [
    ("Apache-2.0", ("Apache2Licensed", "Apache2Use", "Apache2Copy", "Apache2Unless", "Apache2See")),
    ("Apache-2.0", ("Apache2Use", "Apache2Copy", "Apache2Unless", "Apache2See")),
    ("Apache-2.0", ("Apache2Licensed",)),
    ("MIT", ("MitPermission", "MitNotice", "MitAsIs")),
    ("MIT", ("MitLicensed",)),
    ("ISC", ("IscPermission", "BsdAsIs")),
    ("ISC", ("IscPermission", "MitAsIs")),
    ("BSD-3-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD", ("BsdLicensed",)),
    ("GPL-3.0-or-later", ("GplFree", "GplVersion3", "GplHope", "GplSee")),
    ("GPL-2.0-or-later", ("GplFree", "GplVersion2", "GplHope", "GplSee")),
    ("GPL-3.0-or-later", ("GplVersion3", "GplHope", "GplSee")),
    ("GPL-2.0-or-later", ("GplVersion2", "GplHope", "GplSee")),
    ("GPL-3.0", ("Gpl3Licensed",)),
    ("GPL-2.0", ("Gpl2Licensed",)),
    ("AGPL-3.0", ("Agpl3Licensed",)),
    ("LGPL-2.1", ("Lgpl21Licensed",)),
    ("LGPL-3.0", ("Lgpl3Licensed",)),
    ("LGPL", ("LgplLicensed",)),
    ("EPL-2.0", ("Epl2Licensed",)),
    ("Zlib", ("ZlibAsIs", "ZlibPermission")),
    ("Zlib", ("ZlibPermission",)),
    ("BSL-1.0", ("BoostLicensed",)),
    ("WTFPL", ("WtfplLicensed",)),
    ("Artistic-2.0", ("Artistic2Licensed",)),
    ("MPL-2.0", ("Mpl2Licensed",)),
    ("CC-BY", ("CcByLicensed",)),
    ("CC-BY-SA", ("CcByScLicensed",)),
    ("CC-BY-NC", ("CcByNcLicensed",)),
    ("CC-BY-NC-SA", ("CcByNcSaLicensed",)),
    ("CC0-1.0", ("Cc0Licensed",)),
    ("Unlicense", ("Unlicense",)),
    *((licence, (f"Spdx{name}",)) for licence, name in (
        ("Apache-2.0", "Apache2"), ("MIT", "Mit"), ("ISC", "Isc"), ("BSD-3-Clause", "Bsd3"), ("BSD-2-Clause", "Bsd2"),
        ("GPL-3.0-or-later", "Gpl3Later"), ("GPL-2.0-or-later", "Gpl2Later"), ("GPL-3.0", "Gpl3"), ("GPL-2.0", "Gpl2"), ("AGPL-3.0", "Agpl3"), ("LGPL-2.1", "Lgpl21"), ("LGPL-3.0", "Lgpl3"), ("LGPL", "Lgpl"),
        ("EPL-2.0", "Epl2"), ("Zlib", "Zlib"), ("BSL-1.0", "Bsl1"), ("WTFPL", "Wtfpl"), ("Artistic-2.0", "Artistic2"),
        ("MPL-2.0", "Mpl2"), ("CC-BY", "CcBy"), ("CC-BY-SA", "CcBySa"), ("CC-BY-NC", "CcByNc"), ("CC-BY-NC-SA", "CcByNcSa"), ("CC0-1.0", "Cc0"), ("Unlicense", "Unlicense"),
    )),
]
#: Names of licences, in normalised sentences (fixed values)
_V = r"(?: licen[sc]e)?(?: ?version| ?v)? ?"
_GNU = {"GPL": r"(?:gnu )?(?:general public licen[sc]e|gpl)", "AGPL": r"(?:gnu )?(?:affero general public licen[sc]e|agpl)", "LGPL": r"(?:gnu )?(?:lesser general public licen[sc]e|library general public licen[sc]e|lgpl)"}
_CC = {"": "", "-SA": r"[ ]?(?:sa|share ?alike)", "-ND": r"[ ]?(?:nd|no ?derivatives|no ?derivs)", "-NC": r"[ ]?(?:nc|non ?commercial)", "-NC-SA": r"[ ]?(?:nc sa|non ?commercial share ?alike)", "-NC-ND": r"[ ]?(?:nc nd|non ?commercial no ?deriv(?:ative)?s)"}
NAMES = [
    *((f"{k}-{v}-or-later", rf"{n}{_V}{v.replace('.', ' ').removesuffix(' 0')}(?: 0)?(?: or(?: at your option)?(?: any)? later(?: version)?| plus)") for k, n in _GNU.items() for v in ("1.0", "2.0", "2.1", "3.0")),
    *((f"{k}-{v}", rf"{n}{_V}{v.replace('.', ' ').removesuffix(' 0')}(?: 0)?(?: only)?") for k, n in _GNU.items() for v in ("1.0", "2.0", "2.1", "3.0")),
    *((f"CC-BY{k}", rf"(?:cc by|creative commons attribution){n}(?: international| licen[sc]e)*(?: [1-4] 0)?(?: international| unported)?") for k, n in reversed(_CC.items())),
    ("CC0-1.0", r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?"), ("MIT-0", r"mit 0|mit no attribution"), ("MIT", r"mit expat|mit x11|mit|expat"), ("X11", "x11"), ("ISC", "isc"), ("NCSA", r"(?:university of illinois )?ncsa(?: open source)?"),
    ("Apache-2.0", rf"apache(?: software)?{_V}2(?: 0)?"), ("Apache-1.1", rf"apache(?: software)?{_V}1 1"),
    ("0BSD", r"0bsd|zero clause bsd"), ("BSD-2-Clause", r"simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd"), ("BSD-3-Clause", r"new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd"), ("BSD-4-Clause", r"original bsd|bsd 4 clause|4 clause bsd"), ("BSD", "bsd"),
    ("MPL-2.0", rf"(?:mozilla public licen[sc]e|mpl){_V}2(?: 0)?"), ("MPL-1.1", rf"(?:mozilla public licen[sc]e|mpl){_V}1 1"), ("EPL-2.0", rf"(?:eclipse public licen[sc]e|epl){_V}2(?: 0)?"), ("EPL-1.0", rf"(?:eclipse public licen[sc]e|epl){_V}1(?: 0)?"),
    ("EUPL-1.2", rf"(?:european union public licen[sc]e|eupl){_V}1 2"), ("EUPL-1.1", rf"(?:european union public licen[sc]e|eupl){_V}1 1"), ("CDDL-1.1", rf"(?:common development and distribution licen[sc]e|cddl){_V}1 1"), ("CDDL-1.0", rf"(?:common development and distribution licen[sc]e|cddl){_V}1(?: 0)?"),
    ("CPL-1.0", rf"(?:common public licen[sc]e|cpl){_V}1(?: 0)?"), ("AFL-3.0", rf"(?:academic free licen[sc]e|afl){_V}3(?: 0)?"), ("OSL-3.0", rf"(?:open software licen[sc]e|osl){_V}3(?: 0)?"), ("BSL-1.0", rf"boost(?: software)?{_V}1(?: 0)?|boost software|bsl 1 0"), ("BUSL-1.1", rf"(?:business source licen[sc]e|busl){_V}1 1"),
    ("SSPL-1.0", rf"(?:server side public licen[sc]e|sspl){_V}1(?: 0)?"), ("Elastic-2.0", rf"elastic{_V}2(?: 0)?"), ("OFL-1.1", rf"(?:sil )?(?:open font licen[sc]e|ofl){_V}1 1"), ("ODbL-1.0", rf"(?:open (?:data commons open )?database licen[sc]e|odbl){_V}(?:1(?: 0)?)?"), ("Artistic-2.0", rf"artistic{_V}2(?: 0)?"), ("Artistic-1.0", rf"artistic{_V}1(?: 0)?"),
    ("CECILL-2.1", rf"cecill{_V}2 1"), ("PHP-3.01", rf"php{_V}3 01"), ("PSF-2.0", rf"(?:python software foundation|psf){_V}(?:2(?: 0)?)?"), ("PostgreSQL", "postgresql"), ("Ruby", "ruby"), ("Vim", "vim"), ("Zlib", r"zlib(?: libpng)?"), ("MS-PL", r"microsoft public|ms pl"), ("MS-RL", r"microsoft reciprocal|ms rl"), ("WTFPL", r"wtfpl|do what the fuck you want to(?: public)?"), ("Unlicense", r"unlicense"), ("JSON", "json"), ("Beerware", r"beer ?ware"),
]
#: Sentences around a name, whole and normalised; identifiers are ``Title:MIT`` and so on.
_NAME = "|".join(f"(?P<n{i}>{p})" for i, (_, p) in enumerate(NAMES))
_LICENCE = r"(?: licen[sc]e)?"
TEMPLATES = {
    "Licensed": re.compile(rf"(?:.* )?(?:(?:dual )?licen[sc]ed|released|distributed|(?:made )?available|published|provided|covered|governed) (?:under|by|with|according to)(?: the)?(?: terms(?: and conditions)? of)?(?: the| a)? (?:{_NAME}){_LICENCE}(?: .*)?"),
    "Adjective": re.compile(rf"(?:.* )?(?:is|are) (?:{_NAME}){_LICENCE} licen[sc]ed|(?:.* )?licen[sc]e is(?: the)? (?:{re.sub('<n', '<m', _NAME)}){_LICENCE}"),
    "Title": re.compile(rf"(?:the )?(?:{_NAME})(?<=licen[sc]e)(?: (?:version|v)? ?[0-9 ]*)?|(?:the )?(?:{re.sub('<n', '<m', _NAME)}) licen[sc]e(?: [a-z]{{2,10}})?|(?:the )?(?:{re.sub('<n', '<k', _NAME)})(?: [0-9]{{1,2}})? (?:january|february|march|april|may|june|july|august|september|october|november|december) (?:[0-9]{{1,2}} )?[0-9]{{4}}|(?:the )?(?=.*licen[sc]e)(?:{re.sub('<n', '<j', _NAME)})"),
}
_MORE = re.compile(rf"{_LICENCE} (?:and|or)(?: the)? (?:{_NAME})(?![a-z0-9])")
_WHOLE_NAME = re.compile(rf"(?:the )?(?:{_NAME}){_LICENCE}")
#: Other known sentences that may stand between those of a rule.
GAP = 2
#: Operators of an expression, and an identifier.
_EXPRESSION = re.compile(r"\(|\)|\b(?:OR|AND|WITH)\b|[A-Za-z0-9][A-Za-z0-9.+-]*")
_CASE = {name.lower(): name for name, _ in NAMES}


def named(plain: str, pattern: re.Pattern) -> list[str]:
    """The licences that a normalised sentence of this form names: the first, and those that follow it after "and" or "or"."""
    m = pattern.fullmatch(plain)
    out = []
    while m:
        group, value = next((g, v) for g, v in m.groupdict().items() if v is not None)
        out.append(NAMES[int(group[1:])][0])
        m = _MORE.match(plain, m.end(group))
    return out


def expression(text: str) -> list[str]:
    """The licences of an SPDX expression in order, each with its exception; nothing if it is no expression.

    ``-only`` is left out and a plus is ``-or-later``, as rules name licences.
    """
    out: list[str] = []
    depth, wants = 0, True
    for part in _EXPRESSION.findall(text):
        if part == "(":
            if not wants:
                return []
            depth += 1
        elif part == ")":
            depth -= 1
            if wants or depth < 0:
                return []
        elif part in ("OR", "AND", "WITH"):
            if wants:
                return []
            wants = True
            out.append(part)
        elif not wants:
            return []
        else:
            name = re.sub(r"\+$", "-or-later", part).removesuffix("-only") if not part.lower().endswith("-only") else part[:-5]
            out.append(_CASE.get(name.lower(), re.sub(r"^(CC-BY(?:-NC)?(?:-SA|-ND)?)-[1-4]\.0$", r"\1", name)))
            wants = False
    if wants or depth or not _EXPRESSION.sub("", text).strip(" \t\"'*/#;,.->") == "":
        return []
    licences: list[str] = []
    for i, part in enumerate(out):
        if part == "WITH" and licences:
            licences[-1] += f" WITH {out[i + 1]}"
        elif part not in ("OR", "AND", "WITH") and (not i or out[i - 1] != "WITH"):
            licences.append(part)
    return licences


#: A sentence without any of these is none of ``SENTENCES``: each of their patterns needs one, whatever stands between words.  Other patterns are tried on every sentence.
_NEEDED = re.compile("licen|copyright|permission|warrant|redistribution|public[^a-z0-9]+domain|under|endorse|version[^a-z0-9]+[23][^a-z0-9]+of|spdx|free[^a-z0-9]+software|as[^a-z0-9]+is|cc0|c[^a-z0-9]+(?:c[^a-z0-9]+)?[0-9]{4}", re.I)
_BREAK = re.compile(r"(?<=[.!?;])\s+|(?<!Identifier:)(?<!identifier:)(?<![Ll]icense:)(?<![Ll]icence:)(?<!LICENSE:)(?<=:)\s+|\n\s*\n|\n(?=[ \t]*(?:[*#/-]+[ \t]*)?(?:Licen[sc]ed|Released|Distributed|Available|Copyright|Permission|Redistribution|This|The|THE SOFTWARE|THIS|You|Unless|See|Neither|SPDX|\(c\)|[0-9]+[.)] ))")
#: A tag ends with its line.
_TAG = re.compile(r"SPDX-License-Identifier:[^\n]*|(?:(?<=\n)|(?<![\s\S]))[ \t#*/\"'-]*licen[cs]e[\"']?[ \t]*[:=][^\n]*", re.I)
_VALUE = re.compile(r"^[^:=]*[:=][ \t]*(.*)$", re.S)
_OTHER = re.compile(r"[^a-z0-9]+")


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(start, sentence); a blank line, a line break before a word that opens licence sentences, and the line of an SPDX tag end one too."""
    at = 0
    for m in _BREAK.finditer(text):
        yield from _parts(at, text[at : m.start()])
        at = m.end()
    yield from _parts(at, text[at:])


def _parts(at: int, sentence: str) -> Iterator[tuple[int, str]]:
    done = 0
    for m in _TAG.finditer(sentence):
        if done < m.start():
            yield at + done, sentence[done : m.start()]
        yield at + m.start(), m[0]
        done = m.end()
    if done < len(sentence) or not done:
        yield at + done, sentence[done:]


def normalised(sentence: str) -> str:
    """Lower case; letters, digits and single spaces."""
    return _OTHER.sub(" ", sentence.lower()).strip()


@dataclass(frozen=True)
class Rules:
    """Known sentences and licence rules, compiled."""

    known: tuple[tuple[str, re.Pattern], ...]
    rules: tuple[tuple[str, tuple[str, ...]], ...]
    needed: re.Pattern | None = None

    @classmethod
    def of(cls, known: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> Rules:
        """Patterns are tried in order; longer rules go first, equal ones in order."""
        return cls(tuple((k, re.compile(p)) for k, p in known.items()), tuple(sorted(rules, key=lambda r: -len(r[1]))), _NEEDED if known is SENTENCES else None)

    def identify(self, sentence: str) -> str | None:
        """The identifier of a sentence, the first of several."""
        return next(iter(self.identifiers(sentence)), None)

    def identifiers(self, sentence: str) -> list[str]:
        """A known sentence gives one; a tag gives one for each licence of its expression."""
        plain = normalised(sentence)
        if not plain:
            return []
        found = next((k for k, p in self.known if p.fullmatch(plain)), None)
        if self.needed is None or found not in (None, "SpdxTag"):
            return [found] if found else []
        if _TAG.match(sentence.lstrip(" \t#*/\"'-")):
            value = _VALUE.match(sentence)[1].strip(" \t\r\"'*/#;,.->")
            later = value.endswith("+")
            names = named(normalised(value.rstrip("+")) + " or later" * later, _WHOLE_NAME)
            if not names:  # a tag may hold any identifiers; another line at least one that is known
                names = [x for x in expression(value) if plain.startswith("spdx") or x.split(" ")[0] in _CASE.values()]
            licences = names
            if licences:
                return [f"Tag:{x}" for x in licences]
        for kind, pattern in TEMPLATES.items():
            names = named(plain, pattern)
            if names:
                return [f"{kind}:{x}" for x in names]
        return [found] if found else []

    def scan(self, text: str) -> tuple[list[tuple[str, int, int]], list[str], list[str]]:
        """(identifier, start, end) of known sentences, licences in order, and identifiers left unexplained."""
        may = self.needed.search if self.needed else bool
        found = [(k, s, s + len(x)) for s, x in sentences(text) if may(x) for k in self.identifiers(x)] if may(text) else []
        ids = [k for k, _, _ in found]
        licences: list[str] = []
        left: list[str] = []
        taken = [False] * len(ids)
        for at, first in enumerate(ids):
            if taken[at]:
                continue
            licence, places = self._rule_at(ids, taken, at)
            if licence is None:
                left.append(first)
            else:
                for i in places:
                    taken[i] = True
                if licence not in licences:
                    licences.append(licence)
        return found, licences, left

    def _rule_at(self, ids: list[str], taken: list[bool], at: int) -> tuple[str | None, list[int]]:
        """The longest rule that begins here, and the places that it explains."""
        for licence, rule in self.rules:
            if rule[0] != ids[at]:
                continue
            places = [at]
            for wanted in rule[1:]:
                free = [i for i in range(places[-1] + 1, min(len(ids), places[-1] + 2 + GAP)) if not taken[i]]
                place = next((i for i in free if ids[i] == wanted), None)
                if place is None:
                    break
                places.append(place)
            else:
                return licence, places
        kind, _, name = ids[at].partition(":")
        return (name, [at]) if name and (kind == "Tag" or kind in TEMPLATES) and self.needed else (None, [])


def scan_licences(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """One row per document: doc_id, licences, sentence_ids, unexplained (arrays, in text order), spans.

    A null or empty text has no sentences, and a long one is read whole; rows with a
    null or repeated doc_id are documents of their own; a sentence that several
    patterns match is the first of them, and of rules that match at a place the
    longest wins, then the earlier.  An empty table gives no rows; other columns
    of ``docs`` are not read.
    """
    use = rules or Rules.of()
    names = pa.list_(pa.string())
    kind = pa.schema([("doc_id", pa.int64()), ("licences", names), ("sentence_ids", names), ("unexplained", names), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches_by_bytes(whole, "text"):
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    found, licences, left = use.scan(text)
                    out.append((doc_id, licences, [k for k, _, _ in found], left, [{"start": s, "end": e} for _, s, e in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kind, strict=True)], schema=kind)

    return texts(docs).mapInArrow(run, "doc_id long, licences array<string>, sentence_ids array<string>, unexplained array<string>, spans array<struct<start:long,end:long>>")

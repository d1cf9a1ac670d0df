"""Licence scan by sentence rules.

Texts are cut into sentences, sentences are normalised and looked up in a table
of known licence sentences. The identifiers found, in order, are matched
against licence rules, which are ordered lists of identifiers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import INT, LONG, STRING, struct

# Public licence sentences, normalised, by identifier.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache-notice": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
    ),
    "apache-copy": ("you may obtain a copy of the license at",),
    "apache-comply": ("you may not use this file except in compliance with the license",),
    "apache-warranty": (
        "unless required by applicable law or agreed to in writing software distributed under the "
        "license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied",
    ),
    "apache-see": (
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "mit-notice": ("released under the mit license", "licensed under the mit license", "the mit license", "mit license"),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to "
        "do so subject to the following conditions",
    ),
    "mit-include": (
        "the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software",
    ),
    "mit-warranty": (
        "the software is provided as is without warranty of any kind express or implied including but "
        "not limited to the warranties of merchantability fitness for a particular purpose and "
        "noninfringement",
    ),
    "isc-grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without "
        "fee is hereby granted provided that the above copyright notice and this permission notice "
        "appear in all copies",
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met",
    ),
    "bsd-source": (
        "redistributions of source code must retain the above copyright notice this list of conditions "
        "and the following disclaimer",
    ),
    "bsd-binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided "
        "with the distribution",
    ),
    "bsd-endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission",
    ),
    "gpl3-notice": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
    ),
    "gpl2-notice": (
        "this work is licensed under the gnu general public license version 2",
        "licensed under the gnu general public license version 2",
    ),
    "gpl-free": (
        "this program is free software you can redistribute it and or modify it under the terms of the "
        "gnu general public license as published by the free software foundation either version 3 of "
        "the license or at your option any later version",
    ),
    "gpl-warranty": tuple(
        f"this {subject} is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose"
        for subject in ("program", "library", "software", "file", "project")
    ),
    "gpl-see": tuple(
        f"see the gnu {kind}general public license for more details" for kind in ("", "lesser ", "library ", "affero ")
    ),
    "mpl-notice": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    "cc-by-nc-notice": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"),
    "cc-by-sa-notice": ("licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0"),
    "cc-by-notice": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0"),
    "unlicense-grant": ("this is free and unencumbered software released into the public domain",),
    "reserved": ("all rights reserved",),
    "cc0-waiver": ("cc0 1 0 universal", "creative commons cc0 1 0 universal"),
}

# Rules by licence, the longest of those that match at a place holds.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Apache-2.0", ("apache-notice", "apache-comply", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice", "mit-grant", "mit-include", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-include", "mit-warranty")),
    ("MIT", ("mit-notice",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-2.0-only", ("gpl2-notice",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("Unlicense", ("unlicense-grant",)),
    ("Proprietary", ("reserved",)),
)

# Names of licences in notices, as patterns over normalised text, and the sentence a notice counts as.
_GNU = {
    "GPL": r"(?:gnu )?(?:general public licen[sc]e|gpl)",
    "LGPL": r"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)",
    "AGPL": r"(?:gnu )?(?:affero general public licen[sc]e|agpl)",
}
_GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2 1", "3"), "AGPL": ("3",)}
NOTICES: dict[str, tuple[str, str | None]] = {
    "Apache-2.0": (r"(?:apache(?: software)? licen[sc]e|apache) (?:version |v ?)?2(?: 0)?(?: licen[sc]e)?", "apache-notice"),
    "MIT": (r"mit(?: licen[sc]e)?|expat licen[sc]e", "mit-notice"),
    "ISC": (r"isc(?: licen[sc]e)?", None),
    "BSD-3-Clause": (r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", None),
    "BSD-2-Clause": (r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[sc]e)?", None),
    "MPL-2.0": (r"(?:mozilla public licen[sc]e|mpl) (?:version |v ?)?2(?: 0)?", "mpl-notice"),
    "EPL-1.0": (r"(?:eclipse public licen[sc]e|epl) (?:version |v ?)?1(?: 0)?", None),
    "EPL-2.0": (r"(?:eclipse public licen[sc]e|epl) (?:version |v ?)?2(?: 0)?", None),
    "CC0-1.0": (r"(?:creative commons )?(?:cc0|zero)(?: (?:v ?)?1 0)?(?: universal)?(?: licen[sc]e)?", None),
    "Unlicense": (r"unlicense(?: licen[sc]e)?", None),
} | {
    f"CC-{kind.upper().replace(' ', '-')}-4.0": (
        rf"(?:(?:creative commons|cc) {kind}|creative commons {long})(?: (?:version |v ?)?4 0)(?: international)?(?: licen[sc]e)?",
        f"cc-{kind.replace(' ', '-')}-notice",
    )
    for kind, long in (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nc", "attribution non ?commercial"))
} | {
    f"{kind}-{version.replace(' ', '.') if ' ' in version else version + '.0'}-{later}": (
        rf"{_GNU[kind]} (?:version |v ?)?{version}{'' if ' ' in version else '(?: 0)?'}{tail}",
        {"GPL-3-only": "gpl3-notice", "GPL-2-only": "gpl2-notice"}.get(f"{kind}-{version}-{later}"),
    )
    for kind, versions in _GNU_VERSIONS.items()
    for version in versions
    for later, tail in (("or-later", r" (?:or (?:at your option )?(?:any )?later(?: version)?)"), ("only", "(?: only)?"))
}
_NAMES = [(licence, re.compile(pattern)) for licence, (pattern, _) in NOTICES.items()]
_SUBJECT = (
    r"(?:(?:this|the|all|our)(?: [a-z0-9]+){1,4} (?:is|are) |it is |(?:code|project|software) is |"
    r"this program and the accompanying materials are )?(?:dual )?"
)
_VERB = (
    r"(?:(?:licen[sc]ed|released|distributed|available|made available|provided|published|redistributable|covered|"
    r"offered|shared|open sourced)(?: to you)? (?:under|by)|subject to|governed by|"
    r"dedicated to the public domain under) "
)
_TERMS = r"(?:the )?(?:terms(?: and conditions)? of )?(?:either of )?"
_TAIL = (
    r"(?: which .*| see .*| licen[sc]e(?: md| txt)?| as published by the free software foundation|"
    r" at your option| (?:\d+ )?[a-z]+ \d{4})?"
)
_NOTICE = re.compile(rf"{_SUBJECT}{_VERB}{_TERMS}(?P<names>.+)")
_FREE = re.compile(
    r"(?:[a-z0-9 ]{1,60} )?is free software you can redistribute it and or modify it under the terms of the gnu "
    r"(?P<kind>lesser |library |affero )?general public licen[sc]e (?:version [0-9 ]+ )?as published by the free "
    r"software foundation (?P<either>either )?version (?P<version>2 1|2|3)(?: 0)?(?: of the licen[sc]e)?"
    r"(?P<later> or at your option any later version)?"
)
_WAIVER = re.compile(
    r"to the extent possible under law .{1,80} waived all copyright and related or neighbou?ring rights to .{1,80}"
)
#: A notice is no longer than this, normalised.
NOTICE_LENGTH = 400
_SPDX_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
_SPDX = re.compile(
    rf"SPDX-License-Identifier:[^\S\n]*({_SPDX_ID}(?:[^\S\n]+(?:AND|OR|WITH)[^\S\n]+{_SPDX_ID})*)", re.IGNORECASE
)
#: Licences that a notice or an SPDX line names are written behind this in the identifier of its sentence.
NAMED = "names "

#: One of these stands in every known sentence, so texts without any hold none.
HINTS = ("licen", "free software", "cc0", "under law", "permission", "redistribut", "copyright", "warrant", "unencumbered", "rights reserved")
#: Unknown sentences that may stand between two sentences of a rule.
GAP = 2

_KNOWN = {text: name for name, texts in SENTENCES.items() for text in texts}
_BREAK = re.compile(r"(?<=[.!?;:])[\s]+|\n\s*")
_PLUS = re.compile(r"(gpl[\s_-]*v?\d(?:\.\d)?)\+")
_NOISE = re.compile(r"[\W_]+")
#: A sentence that wraps over lines is tried over so many lines.
WRAP = 12

Sentence = tuple[int, int, str | None]


def normalised(sentence: str) -> str:
    return _NOISE.sub(" ", _PLUS.sub(r"\1 or later", sentence.lower())).strip()


_LONGEST = max(map(len, _KNOWN))
_STARTS = {text[: text.find(" ", 8)] if " " in text[8:] else text for text in _KNOWN}


def _named(names: str) -> list[str] | None:
    """The licences that normalised names joined by 'or' and 'and' are, None if any is unknown."""
    found, at = [], 0
    while True:
        at += len("the ") if names.startswith("the ", at) else 0
        ends = [(m.end(), licence) for licence, name in _NAMES if (m := name.match(names, at)) and names[m.end() : m.end() + 1] in ("", " ")]
        if not ends:
            return None
        at, licence = max(ends, key=lambda e: e[0])
        found.append(licence)
        if re.fullmatch(_TAIL, names[at:]):
            return found
        joint = re.compile(r" (?:and or|or|and)(?: the)? ").match(names, at)
        if not joint:
            return None
        at = joint.end()


def identifier(sentence: str) -> str | None:
    """What a normalised sentence is known as: one of ``SENTENCES``, or the licences that a notice names."""
    if sentence in _KNOWN or len(sentence) > NOTICE_LENGTH:
        return _KNOWN.get(sentence)
    if " is free software " in f" {sentence}" and (m := _FREE.fullmatch(sentence)):
        kind = {"": "GPL", "lesser ": "LGPL", "library ": "LGPL", "affero ": "AGPL"}[m["kind"] or ""]
        version = m["version"].replace(" ", ".") if " " in m["version"] else f"{m['version']}.0"
        later = "or-later" if m["later"] else "only"
        return "gpl-free" if (kind, version, later) == ("GPL", "3.0", "or-later") else f"{NAMED}{kind}-{version}-{later}"
    if sentence.startswith("to the extent") and _WAIVER.fullmatch(sentence):
        return "cc0-waiver"
    notice = _NOTICE.fullmatch(sentence) if " under " in sentence or " by " in sentence or " to " in sentence else None
    names = notice["names"] if notice else sentence if "licen" in sentence else None
    found = _named(names) if names else None
    if not found:
        return None
    one = NOTICES[found[0]][1] if len(found) == 1 else None
    return one or NAMED + " ".join(found)


def _spdx(expression: str) -> str:
    """The identifier of an SPDX line: the licences of its expression, those of other names as written."""
    words = [w.strip("().") for w in expression.split()]
    listed = {licence.lower(): licence for licence in NOTICES}
    found = []
    for before, word in zip(["", *words], words):
        if word.lower() in ("and", "or", "with") or before.lower() == "with":
            continue
        if m := re.fullmatch(r"([AL]?GPL-\d\.\d)(\+?)", word, re.IGNORECASE):
            word = m[1] + ("-or-later" if m[2] else "-only")
        if word.lower() in listed or re.search(r"[A-Z0-9]", word):
            found.append(listed.get(word.lower(), word))
    return NAMED + " ".join(found) if found else "spdx-unknown"


def sentences(text: str) -> list[Sentence]:
    """(start, end, identifier) of the sentences of a text; unknown ones have no identifier.

    Where pieces between breaks form a known sentence only together, as in
    wrapped lines, the longest such run counts as one.
    """
    lines = {m.start(): m for m in _SPDX.finditer(text)} if "spdx" in text.lower() else {}
    breaks = {0, len(text), *(m.end() for m in _BREAK.finditer(text))}
    for m in lines.values():
        breaks -= set(range(m.start() + 1, m.end()))
        breaks |= {m.start(), m.end()}
    cuts = sorted(breaks)
    parts = [(a, b, normalised(text[a:b])) for a, b in zip(cuts, cuts[1:]) if b > a]
    parts = [p for p in parts if p[2]]
    found: list[Sentence] = []
    i = 0
    while i < len(parts):
        if parts[i][0] in lines:
            found.append((*parts[i][:2], _spdx(lines[parts[i][0]][1])))
            i += 1
            continue
        best, joined = None, ""
        for j in range(i, min(len(parts), i + WRAP)):
            joined = f"{joined} {parts[j][2]}".strip()
            if len(joined) > _LONGEST or parts[j][0] in lines:
                break
            name = identifier(joined)
            if name and not (best and best[1] == name and joined not in _KNOWN):
                best = (j, name)
        start = parts[i][0]
        i, name = (best[0] + 1, best[1]) if best else (i + 1, None)
        found.append((start, start + len(text[start : parts[i - 1][1]].rstrip()), name))
    return found


def match_rules(found: list[Sentence]) -> list[dict]:
    """Licences by the rules, leftmost first, then by the number of sentences."""
    return _matched(found)[0]


def _matched(found: list[Sentence]) -> tuple[list[dict], list[str]]:
    """Licences by the rules, and the identifiers of known sentences that no rule used, in order."""
    results, unused, i = [], [], 0
    while i < len(found):
        name = found[i][2]
        best: tuple[int, tuple[str, ...], int] | None = None
        if name and name.startswith(NAMED):
            best = (1, tuple(dict.fromkeys(name.split()[1:])), i)
        elif name:
            for licence, rule in RULES:
                end = _follow(found, i, rule)
                if end is not None and (best is None or len(rule) > best[0]):
                    best = (len(rule), (licence,), end)
            if not best:
                unused.append(name)
        if best:
            place = {"sentences": best[0], "start": found[i][0], "end": found[best[2]][1]}
            results += [{"licence": licence, **place} for licence in best[1]]
            i = best[2]
        i += 1
    return results, unused


def _follow(found: list[Sentence], at: int, rule: tuple[str, ...]) -> int | None:
    """Where the rule ends if its sentences follow in order from ``at``, with small gaps."""
    if found[at][2] != rule[0]:
        return None
    for name in rule[1:]:
        near = range(at + 1, min(len(found), at + 2 + GAP))
        at = next((j for j in near if found[j][2] is not None), -1)
        if at < 0 or found[at][2] != name:
            return None
    return at


def licences_of(text: str | None) -> list[dict]:
    return _licences_of(text)[0]


def _licences_of(text: str | None) -> tuple[list[dict], list[str]]:
    if not text:
        return [], []
    lowered = text.lower()
    if not any(hint in lowered for hint in HINTS):
        return [], []
    return _matched(sentences(text))


_FOUND = T.ArrayType(struct(licence=STRING, sentences=INT, start=LONG, end=LONG))


@F.pandas_udf(struct(found=_FOUND, unused=T.ArrayType(STRING)))
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([_licences_of(t) for t in batch], columns=["found", "unused"])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_licences, licences (distinct names, sorted), found, unused.

    ``found`` lists matches in order, with code points of start and end (end
    exclusive), ``unused`` the known sentences that no rule used. Null and empty texts have none. Repeated rows are scanned each
    for itself; other columns are not read.
    """
    rows = docs.select(F.col(doc_id), _scan(F.col(text)).alias("_found")).select(doc_id, "_found.*")
    names = F.array_sort(F.array_distinct(F.col("found.licence")))
    return rows.select(doc_id, F.size("found").cast("long").alias("n_licences"), names.alias("licences"), "found", "unused")

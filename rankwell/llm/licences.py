"""Licence recognition by sentence rules.

The words of a text, whatever its line wrapping and comment signs, are searched for known licence
sentences, which have identifiers: sentences of the public licences and their notices, and the usual
one-line notices and tags, made of a lead, a name and a version. The identifiers of a text, in order,
are matched against rules: ordered lists of identifiers that together are a licence. Longer rules
come first and keep the sentences they match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import whole_text

GAP = 3  # sentences of another kind that may lie between two of a rule

# Sentences of public licences and notices, normalised; # stands for a version.
SENTENCES = {
    "mit.release": "released under the mit license",
    "mit.licensed": "licensed under the mit license",
    "mit.grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction including without limitation"
        " the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to"
        " permit persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit.notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial"
        " portions of the software"
    ),
    "mit.warranty": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to"
        " the warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    "apache.licensed": "licensed under the apache license version #",
    "apache.header": "licensed under the apache license version # the license",
    "apache.comply": "you may not use this file except in compliance with the license",
    "apache.copy": "you may obtain a copy of the license at http www apache org licenses license #",
    "apache.basis": (
        "unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "gpl.work": "this work is licensed under the gnu general public license version #",
    "gpl.licensed": "licensed under the gnu general public license version #",
    "gpl.free": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version # of the license or at your"
        " option any later version"
    ),
    "gpl.warranty": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the"
        " implied warranty of merchantability or fitness for a particular purpose"
    ),
    "lgpl.licensed": "licensed under the gnu lesser general public license version #",
    "agpl.licensed": "licensed under the gnu affero general public license version #",
    "mpl.subject": "this source code form is subject to the terms of the mozilla public license v #",
    "bsd.redistribution": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met"
    ),
    "bsd.source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the"
        " following disclaimer"
    ),
    "bsd.binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "bsd.endorse": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission"
    ),
    "isc.grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "cc.by": "licensed under cc by #",
    "cc.by-sa": "licensed under cc by sa #",
    "cc.by-nc": "licensed under cc by nc #",
    "cc.by-nd": "licensed under cc by nd #",
    "cc.by-nc-sa": "licensed under cc by nc sa #",
    "cc.by-nc-nd": "licensed under cc by nc nd #",
    "cc.work": "this work is licensed under a creative commons attribution # international license",
    "copyright.reserved": "all rights reserved",
    "apache.title": "apache license version # january #",
    "apache.grant": (
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"
        " copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and"
        " distribute the work and such derivative works in source or object form"
    ),
    "apache.patent": (
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"
        " except as stated in this section patent license to make have made use offer to sell sell import and"
        " otherwise transfer the work"
    ),
    "gpl.title-2": "gnu general public license version # june #",
    "gpl.title-3": "gnu general public license version # # june #",
    "gpl.copyleft": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "gpl.freedom": "the licenses for most software are designed to take away your freedom to share and change it",
    "gpl.file": (
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as"
        " published by the free software foundation either version # of the license or at your option any later version"
    ),
    "gpl.only": (
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " version # as published by the free software foundation"
    ),
    "lgpl.title-2": "gnu lesser general public license version # february #",
    "lgpl.title-3": "gnu lesser general public license version # # june #",
    "lgpl.terms": (
        "this version of the gnu lesser general public license incorporates the terms and conditions of version # of"
        " the gnu general public license"
    ),
    "lgpl.file": (
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public"
        " license as published by the free software foundation either version # of the license or at your option any"
        " later version"
    ),
    "agpl.title": "gnu affero general public license version # # november #",
    "agpl.copyleft": (
        "the gnu affero general public license is a free copyleft license for software and other kinds of works"
        " specifically designed to ensure cooperation with the community in the case of network server software"
    ),
    "agpl.file": (
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public"
        " license as published by the free software foundation either version # of the license or at your option any"
        " later version"
    ),
    "mpl.title": "mozilla public license version #",
    "mpl.contributor": (
        "means each individual or legal entity that creates contributes to the creation of or owns covered software"
    ),
    "isc.warranty": (
        "the software is provided as is and the author disclaims all warranties with regard to this software including"
        " all implied warranties of merchantability and fitness"
    ),
    "zero.grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted"
    ),
    "unlicense.domain": "this is free and unencumbered software released into the public domain",
    "unlicense.anyone": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form"
        " or as a compiled binary for any purpose commercial or non commercial and by any means"
    ),
    "zlib.grant": (
        "permission is granted to anyone to use this software for any purpose including commercial applications and to"
        " alter it and redistribute it freely subject to the following restrictions"
    ),
    "boost.title": "boost software license version #",
    "cc.zero": (
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of"
        " his or her rights to the work worldwide under copyright law"
    ),
}

# Licences as ordered lists of sentences.
RULES = {
    "MIT": [["mit.grant", "mit.notice", "mit.warranty"], ["mit.grant", "mit.notice"], ["mit.grant"], ["mit.release"], ["mit.licensed"]],
    "Apache": [
        ["apache.header", "apache.comply", "apache.copy", "apache.basis"], ["apache.header", "apache.comply"], ["apache.licensed"],
        ["apache.header"], ["apache.title"], ["apache.grant", "apache.patent"], ["apache.grant"],
    ],
    "GPL": [
        ["gpl.free", "gpl.warranty"], ["gpl.free"], ["gpl.work"], ["gpl.licensed"], ["gpl.title-3", "gpl.copyleft"],
        ["gpl.title-2", "gpl.freedom"], ["gpl.title-2"], ["gpl.title-3"], ["gpl.copyleft"], ["gpl.file", "gpl.warranty"],
        ["gpl.file"], ["gpl.only"],
    ],
    "LGPL": [["lgpl.licensed"], ["lgpl.title-2"], ["lgpl.title-3", "lgpl.terms"], ["lgpl.title-3"], ["lgpl.terms"], ["lgpl.file"]],
    "AGPL": [["agpl.licensed"], ["agpl.title", "agpl.copyleft"], ["agpl.title"], ["agpl.copyleft"], ["agpl.file"]],
    "MPL": [["mpl.subject"], ["mpl.title", "mpl.contributor"], ["mpl.title"]],
    "BSD-3-Clause": [["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"]],
    "BSD-2-Clause": [["bsd.redistribution", "bsd.source", "bsd.binary"]],
    "ISC": [["isc.grant", "isc.warranty"], ["isc.grant"]],
    "0BSD": [["zero.grant", "isc.warranty"]],
    "Unlicense": [["unlicense.domain", "unlicense.anyone"], ["unlicense.domain"]],
    "Zlib": [["zlib.grant"]],
    "BSL": [["boost.title"]],
    "CC-BY": [["cc.by"], ["cc.work"]],
    "CC-BY-SA": [["cc.by-sa"]],
    "CC-BY-NC": [["cc.by-nc"]],
    "CC-BY-ND": [["cc.by-nd"]],
    "CC-BY-NC-SA": [["cc.by-nc-sa"]],
    "CC-BY-NC-ND": [["cc.by-nc-nd"]],
    "CC0": [["cc.zero"]],
    "All rights reserved": [["copyright.reserved"]],
}

# Names of licences in notices and tags, normalised; a figure in a name must stand there.
NAMES = {
    "MIT": ["mit", "expat"],
    "Apache": ["apache", "apache software"],
    "GPL": ["gnu general public", "gnu gpl", "gpl"],
    "LGPL": ["gnu lesser general public", "gnu library general public", "gnu lgpl", "lgpl"],
    "AGPL": ["gnu affero general public", "gnu agpl", "agpl"],
    "MPL": ["mozilla public", "mpl"],
    "EPL": ["eclipse public", "epl"],
    "EUPL": ["european union public", "eupl"],
    "GFDL": ["gnu free documentation", "gfdl"],
    "BSL": ["boost software"],
    "Artistic": ["artistic"],
    "ISC": ["isc"],
    "Zlib": ["zlib"],
    "Unlicense": ["unlicense"],
    "0BSD": ["0 bsd", "0 clause bsd", "zero clause bsd"],
    "BSD": ["bsd"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "bsd three clause", "new bsd", "modified bsd", "revised bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "bsd two clause", "simplified bsd", "freebsd"],
    "CC0": ["cc 0", "creative commons zero", "creative commons cc 0"],
    "CC-BY": ["cc by", "creative commons attribution", "creative commons by"],
    "CC-BY-SA": ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike", "creative commons by sa"],
    "CC-BY-NC": ["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial", "creative commons by nc"],
    "CC-BY-ND": [
        "cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs",
        "creative commons attribution no derivatives", "creative commons by nd",
    ],
    "CC-BY-NC-SA": [
        "cc by nc sa", "creative commons attribution noncommercial sharealike",
        "creative commons attribution non commercial share alike", "creative commons by nc sa",
    ],
    "CC-BY-NC-ND": [
        "cc by nc nd", "creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs",
        "creative commons attribution non commercial no derivatives", "creative commons by nc nd",
    ],
}
# What may follow a name, and what leads in to it.
ENDINGS = ["", "license", "license version #", "license v #", "license #", "version #", "v #", "#", "# license", "# international license", "# unported license"]
LEADS = [
    "licensed under", "released under", "distributed under", "available under", "published under", "provided under",
    "covered by", "governed by",
]
ARTICLES = ["", "a", "the", "the terms of the", "terms of the", "the terms and conditions of the"]
TAG = "spdx license identifier"


def notices() -> Iterator[tuple[str, str]]:
    """(sentence, licence) of every lead, name and ending; ``GPLv3`` is read as ``gplv #``."""
    leads = [f"{lead} {article}".strip() for lead in LEADS for article in ARTICLES]
    for licence, names in NAMES.items():
        for name in names:
            forms = [f"{name} {ending}".strip() for ending in ENDINGS] + [f"{name}v #"]
            yield from ((f"{lead} {form}", licence) for lead in [*leads, TAG] for form in forms)
            if name.startswith("creative commons"):
                yield from ((form, licence) for form in forms if "#" in form)


@cache
def known_sentences() -> ahocorasick.Automaton:
    """All known sentences between blanks, each with its (identifier, figures it asks for).

    A sentence's own figures are written as # in the automaton and asked for afterwards; None
    stands for any figure, which is the version. Listed sentences go before made ones.
    """
    entries: dict[str, list[tuple[str, list[str | None]]]] = {}
    made = ((sentence, f"notice.{licence}") for sentence, licence in notices())
    for known, name in [*((known, name) for name, known in SENTENCES.items()), *made]:
        figures = [None if w == "#" else w for w in known.split() if w == "#" or w.isdecimal()]
        plain = " ".join("#" if w.isdecimal() else w for w in known.split())
        entries.setdefault(f" {plain} ", []).append((name, figures))
    machine = ahocorasick.Automaton()
    for plain, kinds in entries.items():
        machine.add_word(plain, (len(plain), kinds))
    machine.make_automaton()
    return machine


ORDERED = sorted(
    [(licence, rule) for licence, rules in RULES.items() for rule in rules]
    + [(licence, [f"notice.{licence}"]) for licence in NAMES],
    key=lambda r: (-len(r[1]), r[0], r[1]),
)
# Every known sentence holds one of these, so a text without them holds none.
ANCHORS = re.compile(
    "licen[sc]e|permission|redistribut|copyright|reserved|warrant|released|distribute|available|published|provided"
    "|covered|governed|commons|software",
    re.IGNORECASE,
)
_TOKEN = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
# Words that begin a comment line in some languages.
_REMARK = re.compile(r"^(?:[ \t]*(?:@?rem|dnl)\b|c(?=[ \t]))", re.MULTILINE)
# Sentences end at a mark before a blank or at a line without words; other line ends are wrapping.
_END = re.compile(r"(?<=[.!?])\s+|\n(?:[^\w\n]*\n)+")


def words_of(text: str) -> tuple[str, list[str], list[int], str]:
    """The words of a text between single blanks, with # for numbers; the numbers; where each word is
    in the last, the text without what begins comment lines."""
    plain = _REMARK.sub("", text.lower()).replace("licence", "license").replace("https:", "http:")
    words, numbers, starts = [], [], []
    for m in _TOKEN.finditer(plain):
        word = m.group()
        if word[0].isdecimal():
            numbers.append(word)
            word = "#"
        words.append(word)
        starts.append(m.start())
    return f" {' '.join(words)} ", numbers, starts, plain


def identify(text: str) -> list[tuple[int, str, str | None, int]]:
    """(sentence, identifier, version, first word) of the known sentences of a text.

    A known sentence is found wherever its words follow each other, however they are wrapped, marked as
    comment or led in; of those that overlap the first, then the longest counts. One behind ``not`` does
    not count.
    """
    if not ANCHORS.search(text):
        return []
    flat, numbers, starts, plain = words_of(text)
    met = []
    for last, (length, kinds) in known_sentences().iter(flat):
        met.append((last - length + 1, -length, kinds))
    if not met:
        return []
    ends = [m.end() for m in _END.finditer(plain)]
    sentence = np.unique(np.searchsorted(ends, starts, "right"), return_inverse=True)[1]
    blanks, figures = ([m.start() for m in re.finditer(sign, flat)] for sign in " #")
    found, free = [], 0
    for at, length, kinds in sorted(met, key=lambda m: m[:2]):
        if at < free or flat.endswith(" not", 0, at):
            continue
        here = bisect_left(figures, at)
        for name, asked in kinds:
            given = numbers[here : here + len(asked)]
            if all(a is None or a == g for a, g in zip(asked, given)):
                break
        else:
            continue
        # The blank that ends a sentence may begin the next one.
        free = at - length - 1
        first = bisect_left(blanks, at)
        version = next((g for a, g in zip(asked, given) if a is None), None)
        found.append((int(sentence[first]), name, version, first))
    return found


def match_rules(found: list[tuple[int, str, str | None, int]]) -> list[tuple[str, str | None, int, int, int]]:
    """(licence, version, first place, sentences, first word) of the rules that a text's identifiers meet.

    Each sentence of a rule is the next one of its kind that no rule before has taken, at most ``GAP``
    sentences on. Its places only move forward within a rule, so a rule takes one walk over them.
    """
    places: dict[str, list[int]] = {}
    for k, one in enumerate(found):
        places.setdefault(one[1], []).append(k)
    used = [False] * len(found)
    matches = []
    for licence, rule in ORDERED:
        if not all(name in places for name in rule):
            continue
        at = [0] * len(rule)
        for first in places[rule[0]]:
            taken = [] if used[first] else [first]
            for step in range(1, len(rule)) if taken else ():
                here = places[rule[step]]
                while at[step] < len(here) and (here[at[step]] <= taken[-1] or used[here[at[step]]]):
                    at[step] += 1
                if at[step] == len(here) or found[here[at[step]]][0] - found[taken[-1]][0] > GAP + 1:
                    break
                taken.append(here[at[step]])
            if len(taken) < len(rule):
                continue
            for k in taken:
                used[k] = True
            versions = [found[k][2] for k in taken if found[k][2]]
            matches.append((licence, versions[0] if versions else None, found[taken[0]][0], len(rule), found[taken[0]][3]))
    return sorted(matches, key=lambda m: (m[4], m[0]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for place, text in enumerate(batch.column(1)):
            rows += [(place, *m) for m in match_rules(identify(text.as_py()))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                batch.column(2).take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
                pa.array([r[3] for r in rows], pa.int32()),
                pa.array([r[4] for r in rows], pa.int32()),
                pa.array([r[5] for r in rows], pa.int32()),
            ],
            names=["doc_id", "print", "licence", "version", "place", "sentences", "word"],
        )


def licences_of(docs: DataFrame) -> DataFrame:
    """One row per document and licence: doc_id, licence, version, times, first_place, sentences.

    ``first_place`` is the sentence it first starts at and ``sentences`` the length of the longest rule
    met. Null, empty and unlicensed texts give no row; repeated rows of one key and text give one; null
    keys are kept; an empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select("doc_id", whole_text().alias("text"), F.xxhash64(whole_text()).alias("print"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    met = rows.mapInArrow(_scan, f"doc_id {kind}, print long, licence string, version string, place int, sentences int, word int")
    return (
        met.groupBy("doc_id", "print", "licence", "version")
        .agg(
            F.countDistinct("word").alias("times"),
            F.min("place").alias("first_place"),
            F.max("sentences").alias("sentences"),
        )
        .drop("print")
    )

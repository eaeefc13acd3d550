"""Licence rules against all known sentences tried at all places, public notices, awkward rows."""

import random
import time

import pytest

from rankwell.llm import licences
from rankwell.llm.common import ship_package

FOUND = {
    "SPDX-License-Identifier: MIT": ("MIT", None),
    "# SPDX-License-Identifier: GPL-2.0-or-later": ("GPL", "2.0"),
    "SPDX-License-Identifier: CC0-1.0": ("CC0", "1.0"),
    "Distributed under the MIT License.": ("MIT", None),
    "Licensed under the GPL v3.": ("GPL", "3"),
    "released under GPLv3": ("GPL", "3"),
    "Licensed under the Apache License 2.0.": ("Apache", "2.0"),
    "Licensed under Apache-2.0": ("Apache", "2.0"),
    "Available under the terms of the BSD 3-Clause License.": ("BSD-3-Clause", None),
    "Licensed under the 2-clause BSD license": ("BSD-2-Clause", None),
    "Licensed under the BSD 4-clause license": ("BSD", "4"),  # its clauses
    "Licensed under CC BY.": ("CC-BY", None),
    "Creative Commons Attribution-ShareAlike 4.0 International": ("CC-BY-SA", "4.0"),
    "Apache License\n                           Version 2.0, January 2004": ("Apache", "2.0"),
    "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007": ("GPL", "3"),
    "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991": ("GPL", "2"),
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": ("LGPL", "2.1"),
    "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": ("AGPL", "3"),
    "Mozilla Public License Version 2.0\n====": ("MPL", "2.0"),
    "This is free and unencumbered software released into the public domain.": ("Unlicense", None),
    "Governed by the Eclipse Public\n// License v 2.0": ("EPL", "2.0"),
}


@pytest.mark.parametrize("text", FOUND)
def test_public_notices(text):
    assert [m[:2] for m in licences.match_rules(licences.identify(text))] == [FOUND[text]]


def test_no_notice():
    for text in (
        "not licensed under the MIT license", "The license of nothing.", "under the MIT tent", "mit license plate",
        "All rights were reserved", "", "licensed under", "a copyright of bsd", "SPDX-License-Identifier:",
    ):
        assert licences.match_rules(licences.identify(text)) == [], text


def test_every_sentence_has_an_anchor():
    known = [*licences.SENTENCES.values(), *(sentence for sentence, _ in licences.notices())]
    assert all(licences.ANCHORS.search(sentence) for sentence in known)
    assert {name for rules in licences.RULES.values() for rule in rules for name in rule} <= set(licences.SENTENCES)


def plain_sentences(text, known):
    """Each known sentence at each word, without an automaton."""
    flat, numbers, starts, plain = licences.words_of(text)
    words = flat.split()
    line = [sum(m.end() <= at for m in licences._END.finditer(plain)) for at in starts]
    order = sorted(set(line))
    found, free = [], 0
    for k in range(len(words)):
        best = None
        for name, parts in known:
            if parts[0] != words[k] and not parts[0].isdecimal() and parts[0] != "#":
                continue
            here = words[k : k + len(parts)]
            given = iter(numbers[words[:k].count("#") :])
            figures = [next(given) if w == "#" else w for w in here]
            same = len(here) == len(parts) and all(p == f or (p == "#" and w == "#") for p, f, w in zip(parts, figures, here))
            if same and (best is None or len(" ".join(here)) > best[0]):
                version = next((f for p, f in zip(parts, figures) if p == "#"), None)
                best = (len(" ".join(here)), name, version, len(parts))
        if best and k >= free and not (k and words[k - 1] == "not"):
            found.append((order.index(line[k]), best[1], best[2], k))
            free = k + best[3]
    return found


def plain_matches(found):
    """Every rule, longest first, from every place on, over the sentences no rule has taken."""
    free, matches = list(found), []
    for licence, rule in licences.ORDERED:
        again = True
        while again:
            again = False
            for i, first in enumerate(free):
                taken = [first] if first[1] == rule[0] else []
                for name in rule[1:] if taken else ():
                    later = [f for f in free if f[3] > taken[-1][3] and f[1] == name]
                    if later and later[0][0] - taken[-1][0] <= licences.GAP + 1:
                        taken.append(later[0])
                if taken and len(taken) == len(rule):
                    matches.append((licence, next((f[2] for f in taken if f[2]), None), first[0], len(rule), first[3]))
                    free = [f for f in free if f not in taken]
                    again = True
                    break
    return sorted(matches, key=lambda m: (m[4], m[0]))


def test_rules_equal_all_sentences_at_all_places():
    rng = random.Random(8)
    made = rng.sample(list(licences.notices()), 40)
    listed = list(licences.SENTENCES.items())
    known = [(n, s.split()) for n, s in listed] + [
        (f"notice.{licence}", s.split()) for s, licence in licences.notices() if s.split()[0] in ("licensed", "creative", "spdx")
    ]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            kind = rng.random()
            sentence = rng.choice(listed)[1] if kind < 0.6 else rng.choice(made)[0] if kind < 0.8 else "some words of ours 12"
            if kind < 0.8 and not sentence.startswith(("licensed", "creative", "spdx")) and kind >= 0.6:
                sentence = "licensed under the mit license"
            sentence = " ".join(str(rng.randrange(1, 4)) if w == "#" else w for w in sentence.split())
            if rng.random() < 0.2:
                sentence = "not " + sentence
            parts.append(sentence + rng.choice([". ", " ", "\n", ".\n\n", "\n * ", ", "]))
        text = "".join(parts)
        if any(lead in text for lead in licences.LEADS if lead != "licensed under"):
            # Made notices of the other leads are left out of the plain list.
            text = "".join(p for p in parts if not any(lead in p for lead in licences.LEADS[1:]))
        found = licences.identify(text)
        assert found == plain_sentences(text, known), text
        assert licences.match_rules(found) == plain_matches(found), text


def test_rules_walk_each_place_once():
    """Ten times the sentences take no more than some twenty times as long."""
    for line in ("All rights reserved.\n", licences.SENTENCES["mit.grant"] + " ", "released under the mit license "):
        took = []
        for times in (3_000, 30_000):
            start = time.perf_counter()
            matches = licences.match_rules(licences.identify(line * times))
            took.append(time.perf_counter() - start)
            assert len(matches) == times
        assert took[1] < 20 * took[0] + 1


def test_awkward_rows(spark):
    """Null keys and texts, repeated rows, clashing columns, a very long text, an empty table."""
    ship_package(spark)
    long = "word " * 400_000 + "\nReleased under the MIT License.\n" + "word " * 1000
    rows = [
        (1, "Released under the MIT License.", "x", 1), (1, "Released under the MIT License.", "x", 1), (None, "SPDX-License-Identifier: ISC", "y", 2),
        (2, None, None, None), (3, "", "z", 3), (4, long, "z", 3), (5, "All rights reserved. All rights reserved.", None, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string, print int").repartition(3)
    got = {(r.doc_id, r.licence, r.times, r.first_place) for r in licences.licences_of(docs).collect()}
    assert got == {(1, "MIT", 1, 0), (None, "ISC", 1, 0), (4, "MIT", 1, 0), (5, "All rights reserved", 2, 0)}
    assert licences.licences_of(docs.limit(0)).count() == 0

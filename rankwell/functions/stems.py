"""English word stems, by the published Porter2 rules."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

REMEMBERED = 500_000  # words a Python worker keeps the stems of

# --- fixed values of the published rules ----------------------------------------------------------
WHOLE = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli",
    early="earli", only="onli", singly="singl", sky="sky", news="news", howe="howe", atlas="atlas",
    cosmos="cosmos", bias="bias", andes="andes",
)
KEPT_AFTER_PLURAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())
LONG_STARTS = ("gener", "commun", "arsen")
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
ADJECTIVES = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
ENDINGS = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), "")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE_END = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _after_region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _ending(word: str, rules: dict[str, str]) -> str | None:
    """The longest ending of the word that has a rule."""
    return next((word[k:] for k in range(max(0, len(word) - 7), len(word)) if word[k:] in rules), None)


def _without_plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _without_verb_ending(word: str, first: int) -> str:
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(e)), None)
    if not end:
        return word
    left = word[: -len(end)]
    if end.startswith("eed"):
        return left + "ee" if len(left) >= first else word
    if not _VOWEL.search(left):
        return word
    if left.endswith(("at", "bl", "iz")):
        return left + "e"
    if _DOUBLE_END.search(left):
        return left[:-1]
    return left + "e" if _SHORT_END.search(left) and first >= len(left) else left


@functools.lru_cache(maxsize=REMEMBERED)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if len(word) <= 2 or word in WHOLE:
        return WHOLE.get(word, word)
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)  # a consonant there
    start = next((len(s) for s in LONG_STARTS if word.startswith(s)), None)
    first = _after_region(word, 0) if start is None else start
    second = _after_region(word, first)

    word = _without_plural(word)
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _without_verb_ending(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"

    end = _ending(word, DERIVED)
    if end and len(word) - len(end) >= first:
        before = word[: -len(end)]
        if not (end == "ogi" and before[-1:] != "l") and not (end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            word = before + DERIVED[end]
    end = _ending(word, ADJECTIVES)
    if end and len(word) - len(end) >= (second if end == "ative" else first):
        word = word[: -len(end)] + ADJECTIVES[end]
    end = _ending(word, ENDINGS)
    if end and len(word) - len(end) >= second and (end != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(end)]

    if word.endswith("e"):
        left = word[:-1]
        if len(left) >= second or (len(left) >= first and not _SHORT_END.search(left)):
            word = left
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


def stems(words: Column) -> Column:
    """The stems of lower-case words, in Arrow batches; a Python worker stems each word once."""

    @pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for held in batches:
            yield held.map(stem, na_action="ignore")

    return of(words)

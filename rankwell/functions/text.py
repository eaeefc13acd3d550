"""Small text and number helpers used by the other column functions.

Patterns are written in their natural form and passed through :func:`pattern`, which gives
``\\b`` its ASCII meaning and widens ``\\s`` to the full set of Unicode spaces.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE_CHARACTERS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_PIECES = re.compile(r"\\.|\[\^?|\]|.", re.S)


@cache
def pattern(regex: str, ignore_case: bool = True) -> str:
    """Java regex with ASCII word boundaries and Unicode-aware spaces.

    A boundary before a letter or a group needs only a look behind, one at the end of the pattern
    or of an alternative only a look ahead; patterns keep word characters on that side.
    """
    out, inside = [], False
    pieces = _PIECES.findall(regex)
    for piece, after in zip(pieces, [*pieces[1:], ""]):
        if piece == r"\b" and not inside:
            if after == "(" or after.isalnum():
                piece = r"(?<!\w)"
            elif after in ("", "|", ")"):
                piece = r"(?!\w)"
            else:
                piece = _BOUNDARY
        elif piece == r"\s":
            piece = SPACES if inside else f"[{SPACES}]"
        elif piece in ("[", "[^") and not inside:
            inside = True
        elif piece == "]" and inside:
            inside = False
        out.append(piece)
    return ("(?i)" if ignore_case else "") + "".join(out)


def has(col: Column, regex: str, ignore_case: bool = True) -> Column:
    return col.rlike(pattern(regex, ignore_case))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(col: Column) -> Column:
    """Strip every kind of white space at both ends, not only blanks."""
    return F.btrim(col, F.lit(SPACE_CHARACTERS))


def is_blank(col: Column) -> Column:
    return col.isNull() | (trimmed(col) == "")


def one_of(col: Column, values: list[str]) -> Column:
    """Column value when it belongs to the allowed set, else null."""
    return F.when(col.isin(values), col)


def holds_any(low: Column, words: list[str]) -> Column:
    """Plain substring test for any of the words in lower-case text."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def has_word(col: Column, low: Column, regex: str) -> Column:
    """``has`` for patterns such as ``\\b(one|two words)\\b``, behind a plain search.

    The literal start of each alternative is looked for first; the pattern itself only runs
    where one of them occurs.
    """
    body = re.fullmatch(r"\\b\(?(.*?)\)?\\b", regex)
    parts = body.group(1).lower().split("|") if body else []
    starts = [re.match(r"[\w ]*", part).group() for part in parts]
    found = has(col, regex)
    return holds_any(low, starts) & found if starts and all(starts) else found


def first_match(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the first (label, pattern) rule that matches; null when none does."""
    low = F.lower(col)
    return reduce(
        lambda acc, rule: F.when(has_word(col, low, rule[1]), F.lit(rule[0])).otherwise(acc),
        reversed(rules),
        F.lit(None).cast("string"),
    )


def lookup(col: Column, table: dict) -> Column:
    """Value of ``col`` in a literal map, null when the key is missing."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), col)


# --- numbers -------------------------------------------------------------------------------


def round2(col: Column) -> Column:
    """Half-up on the scaled double; differs from ``round`` for values such as 1.005."""
    return F.floor(col * 100 + 0.5) / F.lit(100.0)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), col))


def is_finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) < F.lit(float("inf")))


# --- accents ---------------------------------------------------------------------------------


@cache
def _fold_tables() -> tuple[str, str, str, dict[str, str]]:
    """(from, to, delete) strings for ``translate``: letters whose compatibility form is one
    ASCII letter or digit, followed by the combining marks, which disappear. Then the letters
    whose form has several characters, such as ligatures, with that form."""
    source, target, several = [], [], {}
    for code in range(0xA0, 0x30000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F
        )
        if len(base) == 1 and base.isascii() and base.isalnum():
            source.append(chr(code))
            target.append(base)
        elif len(base) > 1 and any(c.isascii() and c.isalnum() for c in base):
            several[chr(code)] = base
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(source), "".join(target), marks, several


def fold_accents(col: Column) -> Column:
    """``Café`` to ``Cafe`` and ``ﬁrm`` to ``firm`` inside the JVM.

    One translate table does it, but for letters that become several characters; texts that hold
    one are folded character by character. Text with one byte per character has nothing to fold.
    """
    source, target, marks, several = _fold_tables()
    plain = F.octet_length(col) == F.char_length(col)
    wide = F.create_map([F.lit(x) for pair in several.items() for x in pair])
    spread = F.array_join(F.transform(F.split(col, ""), lambda c: F.coalesce(wide[c], c)), "")
    some = F.length(F.translate(col, "".join(several), "")) != F.length(col)  # far faster than a class of them
    return F.when(plain, col).otherwise(F.translate(F.when(some, spread).otherwise(col), source + marks, target))


# --- lists -------------------------------------------------------------------------------------


def clean_list(items: Column, limit: int) -> Column:
    """Trim, drop blanks, keep the first spelling of each case-insensitive value, then cap."""
    kept = F.filter(F.transform(items, trimmed), lambda x: x != "")

    def firsts(k):
        wanted = F.slice(F.array_distinct(k["keys"]), 1, limit)
        return F.transform(
            wanted, lambda key: F.get(k["kept"], F.array_position(k["keys"], key).cast("int") - 1)
        )

    return let(
        let(kept, lambda x: F.struct(x.alias("kept"), F.transform(x, F.lower).alias("keys"))), firsts
    )


def clean_keywords(items: Column) -> Column:
    """Trim, lower, drop blanks, distinct in first-seen order."""
    return F.array_distinct(
        F.filter(F.transform(items, lambda x: F.lower(trimmed(x))), lambda x: x != "")
    )


def ascii_norm(col: Column) -> Column:
    """Lower case with everything but ``a-z0-9`` removed (titles for similarity)."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def hash_token(col: Column) -> Column:
    """Fold accents, lower, other characters to single blanks, trim; null becomes ``''``."""
    plain = F.regexp_replace(F.lower(fold_accents(F.coalesce(col, F.lit("")))), "[^a-z0-9]+", " ")
    return F.trim(plain)

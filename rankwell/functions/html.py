"""HTML cleaning and visible text, both as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankwell.constants import (
    ALLOWED_TAGS,
    DROP_WITH_CONTENT,
    NAMED_ENTITIES,
    SAFE_SCHEMES,
    STRIP_WITH_CONTENT,
)
from rankwell.functions.text import SPACES, let, lookup, trimmed

# C0 and C1 controls, DEL, blank and no-break blank.
_CONTROLS = "[\\x00-\\x20\\x7f-\\xa0]"


def sanitise_html(html: Column) -> Column:
    """Keep nine tags without attributes (a safe ``href`` survives), drop active content.

    Relative links beginning with ``/`` count as safe here. The text is cut once into tags
    and the runs between them, each tag is rewritten alone, and the pieces are joined.
    """
    cleaned = reduce(
        lambda acc, tag: F.regexp_replace(acc, rf"(?is)<{tag}(?!\w).*?</{tag}>", ""),
        STRIP_WITH_CONTENT,
        html,
    )

    def rewrite(piece):
        tag = F.lower(F.regexp_extract(piece, "^</?([a-zA-Z0-9]+)", 1))
        attributes = F.regexp_extract(piece, "(?s)^</?[a-zA-Z0-9]+(.*)>$", 1)
        value = r"""(?i)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
        href = trimmed(F.concat(*[F.regexp_extract(attributes, value, i) for i in (1, 2, 3)]))
        link = let(
            href,
            lambda h: F.when(
                h.rlike(r"(?i)^(https?://|mailto:|/)"),
                F.concat(
                    F.lit('<a href="'), h, F.lit('" rel="noopener noreferrer" target="_blank">')
                ),
            ).otherwise("<a>"),
        )
        return (
            F.when(~tag.isin(ALLOWED_TAGS), "")
            .when(piece.startswith("</"), F.concat(F.lit("</"), tag, F.lit(">")))
            .when(tag == "br", "<br />")
            .when(tag == "a", link)
            .otherwise(F.concat(F.lit("<"), tag, F.lit(">")))
        )

    pieces = F.regexp_extract_all(
        cleaned, F.lit("</?[a-zA-Z0-9]+[^>]*>|<|[^<]+"), F.lit(0)
    )
    joined = F.array_join(
        F.transform(
            pieces, lambda p: F.when(p.rlike("(?s)^</?[a-zA-Z0-9].*>$"), rewrite(p)).otherwise(p)
        ),
        "",
    )
    return F.when(html != "", trimmed(joined))


def safe_href(href: Column) -> Column:
    """Link without control characters, or null when its scheme is not on the list."""
    clean = trimmed(F.regexp_replace(href, _CONTROLS, ""))
    allowed = reduce(
        lambda acc, s: acc | F.lower(clean).startswith(s), SAFE_SCHEMES, F.lit(False)
    )
    return F.when(allowed, clean)


# --- visible text ------------------------------------------------------------------------------

# White space at which the visible text is cut into words.
_GAPS = f"[{SPACES}]"
_DROP = "|".join(DROP_WITH_CONTENT)
_TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<[!?][^>]*+(?:>|\z)"
    rf"|<{_GAPS}*+({_DROP})(?![a-z0-9])[^>]*+>.*?(?:</{_GAPS}*+\1{_GAPS}*+>|\z)"
    rf"|</?{_GAPS}*+[a-z][^>]*+>|</?{_GAPS}*+[a-z][^>]*+\z|<|[^<]++"
)
_HIDDEN = rf"(?is)^<(?:[!?]|{_GAPS}*+(?:{_DROP})(?![a-z0-9])[^>]*+>)"
_TAG = rf"(?is)^<(/?){_GAPS}*+([a-z][a-z0-9]*+)[^>]*+>$"
_BLOCKS = ["p", "ul", "li", "h3", "h4"]
# Elements that can be open: blocks first, then those inside a line.
_OPENING = _BLOCKS + [tag for tag in ALLOWED_TAGS if tag not in (*_BLOCKS, "br")]
_NEVER = 2**31 - 1
_RUN = 256


def _character(code: Column, otherwise: Column) -> Column:
    """Character of a code point given as a long; ``otherwise`` where there is none."""
    usable = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    wide = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(usable, F.decode(F.when(usable, wide), "UTF-32")).otherwise(otherwise)


def decode_entities(text: Column) -> Column:
    """Named references of the fixed list and numeric ones decoded once; others stay as written."""

    def decoded(run: Column) -> Column:
        body = F.substring(run, 2, 2**30)
        name = F.lower(F.rtrim(body, F.lit(";")))
        # Ten decimal or eight hexadecimal digits hold every code point; leading zeros are cut.
        digits = F.ltrim(F.regexp_extract(name, "^#x?([0-9a-f]+)$", 1), F.lit("0"))
        number = F.when(
            name.startswith("#x"),
            F.when(F.length(digits) <= 8, F.conv(digits, 16, 10).try_cast("bigint")),
        ).otherwise(F.when(F.length(digits) <= 10, digits.try_cast("bigint")))
        return (
            F.when(~run.startswith("&") | (F.length(run) == 1), run)
            .when(name.startswith("#"), let(number, lambda n: _character(n, run)))
            .otherwise(F.coalesce(lookup(name, NAMED_ENTITIES), run))
        )

    runs = F.regexp_extract_all(
        text, F.lit("&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);|&|[^&]++"), F.lit(0)
    )
    return F.when(text.contains("&"), F.array_join(F.transform(runs, decoded), "")).otherwise(text)


def _pieces(html: Column) -> Column:
    """Tokens as (step, text): 0 a text, n the start of the nth element, -n its end.

    A break is the text of one blank. Comments, hidden elements and other tags leave no token.
    """
    number = {tag: i for i, tag in enumerate(_OPENING, 1)}

    def piece(token: Column) -> Column:
        return let(F.lower(F.regexp_extract(token, _TAG, 2)), lambda tag: judged(token, tag))

    def judged(token: Column, tag: Column) -> Column:
        closing = F.regexp_extract(token, _TAG, 1) == "/"
        found = lookup(tag, number)
        step = (
            F.when(~token.startswith("<"), 0)
            .when(token.rlike(_HIDDEN), None)
            .when(tag == "", 0)
            .when(tag == "br", F.when(~closing, 0))
            .otherwise(F.when(closing, -found).otherwise(found))
        )
        text = F.when(tag == "br", " ").when(tag == "", decode_entities(token)).otherwise("")
        return F.struct(step.cast("int").alias("step"), text.alias("text"))

    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    return F.filter(F.transform(tokens, piece), lambda p: p["step"].isNotNull())


def _state(depth: Column, filled: Column, first: Column, block: Column, out: Column) -> Column:
    """What is known of the open elements, whatever their number.

    ``first``: depth of the outermost open element of each kind. ``block``: depth of the outermost
    open block inside that element. ``filled``: how many of the open elements, the page
    included, hold text already; they are always the outer ones.
    """
    return F.struct(
        depth.cast("int").alias("depth"), filled.cast("int").alias("filled"),
        first.alias("first"), block.alias("block"), out.alias("out"),
    )


def _step(state: Column, piece: Column) -> Column:
    depth, filled, first, block = (state[k] for k in ("depth", "filled", "first", "block"))
    step, kind = piece["step"], F.abs(piece["step"]) - 1
    is_block = kind < len(_BLOCKS)

    def opened() -> Column:
        # A block is set apart from what its parent holds before it.
        gap = F.when(is_block & (filled > depth), " ").otherwise("")
        at = F.transform(first, lambda f, i: F.when(i == kind, F.least(f, depth)).otherwise(f))
        inner = F.transform(
            block,
            lambda b, i: F.when(is_block & (F.get(first, i) < depth), F.least(b, depth)).otherwise(b),
        )
        return _state(depth + 1, filled, at, inner, F.concat(state["out"], gap))

    def closed(to: Column) -> Column:
        # All elements from the outermost of this kind on end; a block among them leaves a blank.
        blocks = is_block | (F.get(block, kind) != _NEVER)
        shut = lambda values: F.transform(
            values, lambda v: F.when(v >= to, F.lit(_NEVER)).otherwise(v)
        )
        left = F.when(blocks, to + 1).otherwise(F.least(filled, to + 1))
        out = F.concat(state["out"], F.when(blocks, " ").otherwise(""))
        return _state(to, left, shut(first), shut(block), out)

    return (
        F.when(step == 0, _state(
            depth, depth + 1, first, block, F.concat(state["out"], piece["text"])
        ))
        .when(step > 0, opened())
        .when(F.get(first, kind) == _NEVER, state)
        .otherwise(let(F.get(first, kind), closed))
    )


def visible_text(html: Column) -> Column:
    """Text of a page: inline tags vanish, blocks and breaks are set apart by blanks, white space
    is collapsed. Null and empty pages give an empty text.

    Tokens are folded with a state of fixed size, a run of them at a time, so the text grows by
    runs and a long page is not copied once per tag.
    """
    none = F.array_repeat(F.lit(_NEVER), len(_OPENING))

    def folded(pieces: Column) -> Column:
        count = F.size(pieces)
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((count - 1) / _RUN).cast("int")),
            lambda i: F.slice(pieces, i * _RUN + 1, F.lit(_RUN)),
        )
        start = _state(
            F.lit(0), F.lit(0), none, none, F.array().cast("array<string>")
        )

        def run(state: Column, part: Column) -> Column:
            begin = _state(state["depth"], state["filled"], state["first"], state["block"], F.lit(""))
            return let(
                F.aggregate(part, begin, _step),
                lambda s: _state(
                    s["depth"], s["filled"], s["first"], s["block"],
                    F.concat(state["out"], F.array(s["out"])),
                ),
            )

        done = F.aggregate(runs, start, run, lambda s: F.array_join(s["out"], ""))
        return F.when(count > 0, done).otherwise("")

    text = let(_pieces(F.coalesce(html, F.lit(""))), folded)
    return F.trim(F.regexp_replace(text, f"{_GAPS}+", " "))

"""Visible text against a plain reading with a stack of open elements."""

import random
import re

from pyspark.sql import functions as F

from rankwell.constants import ALLOWED_TAGS, DROP_WITH_CONTENT, NAMED_ENTITIES
from rankwell.functions import html, text

_ENTITY = re.compile(r"&(#x[0-9a-fA-F]+|#\d+|[a-zA-Z]+);", re.A)
_TOKEN = re.compile(
    r"(?is)(?P<skip><!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z))"
    r"|<\s*(?P<drop>" + "|".join(DROP_WITH_CONTENT) + r")(?![a-z0-9])[^>]*>"
    r".*?(?:</\s*(?P=drop)\s*>|\Z)"
    r"|<(?P<close>/?)\s*(?P<tag>[a-z][a-z0-9]*)[^>]*>"
    r"|(?P<tail></?\s*[a-z][^>]*\Z)"
    r"|(?P<text><|[^<]+)"
)
_BLOCKS = {"p", "ul", "li", "h3", "h4"}


def _entity(match: re.Match) -> str:
    body = match.group(1)
    if not body.startswith("#"):
        return NAMED_ENTITIES.get(body.lower(), match.group(0))
    code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    usable = 0 < code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF
    return chr(code) if usable else match.group(0)


def decode_text(text: str) -> str:
    return _ENTITY.sub(_entity, text)


def visible_text(html: str | None) -> str:
    """Text of one page: inline tags vanish, blocks and breaks are set apart by blanks."""
    open_tags: list[str] = []
    parts: list[list[str]] = [[]]

    def close(depth: int) -> None:
        while len(open_tags) > depth:
            inner, block = "".join(parts.pop()), open_tags.pop() in _BLOCKS
            last = next((p for p in reversed(parts[-1]) if p), "") if block else ""
            gap = " " if last and not last.endswith(" ") else ""
            parts[-1] += [gap, inner, " "] if block else [inner]

    for token in _TOKEN.finditer(html or ""):
        tag = (token["tag"] or "").lower()
        if token["text"] or token["tail"]:
            parts[-1].append(decode_text(token["text"] or token["tail"]))
        elif tag == "br" and not token["close"]:
            parts[-1].append(" ")
        elif tag in ALLOWED_TAGS and token["close"]:
            if tag in open_tags:
                close(open_tags.index(tag))
        elif tag in ALLOWED_TAGS:
            open_tags.append(tag)
            parts.append([])
    close(0)
    return re.sub(f"[{text.SPACES}]+", " ", "".join(parts[0])).strip(" ")



def pages_of_noise(count, seed):
    """Pages of tags in any order: unclosed, crossed, nested in themselves, cut off."""
    rng = random.Random(seed)
    tags = [*ALLOWED_TAGS, "div", "B", "script", "svg", "P", "LI"]
    loose = ["<", "< p >", "</ p >", "<!-- x", "<!doctype y>", "&amp;lt;", "&#x41;", "&#0;", "&#55296;", "&NBSP;", "&", ";",
             "&#1114112;", "&#99999999999999999999;", "&#x1F600;", "<p", "\n", "\u00a0", "&copy;", "&#000065;", "é"]
    pages = []
    for _ in range(count):
        out = []
        for _ in range(rng.randrange(40)):
            kind = rng.randrange(10)
            if kind < 4:
                out.append(rng.choice("ab cd "))
            elif kind < 6:
                out.append(f"<{rng.choice(tags)}{rng.choice(['', ' class=x', ' a=1 /'])}>")
            elif kind < 9:
                out.append(f"</{rng.choice(tags)}>")
            else:
                out.append(rng.choice(loose))
        pages.append("".join(out))
    return pages


def test_visible_text_equals_a_stack_of_elements(apply):
    pages = [*pages_of_noise(3000, 5), "", None, "   ", "<p></p>", "x" * 300_000]
    assert apply(pages, html.visible_text) == [visible_text(p) for p in pages]


def test_visible_text_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select("html", html.visible_text(F.col("html")).alias("text")).collect()
    assert rows and all(r.text == visible_text(r.html) for r in rows)


def test_visible_text_of_long_pages(apply):
    """Time grows with the page: 120,000 tags that never close, and as many in turn."""
    pages = ["<em>x<p>" * 60_000, "<ul><li>a</ul>" * 30_000]
    got = apply(pages, html.visible_text)
    assert got[0] == " ".join(["x"] * 60_000) and got[1] == " ".join(["a"] * 30_000)


def test_references_are_decoded_once(apply):
    texts = ["&amp;lt;", "&#x41;&#66;", "&#0;&#xD800;&#1114112;", "&nope;&", None, "", "a", "&hellip;&#128512;"]
    want = ["&lt;", "AB", "&#0;&#xD800;&#1114112;", "&nope;&", None, "", "a", "…😀"]
    assert apply(texts, html.decode_entities) == want

"""Leaf blocks of an HTML page: the runs of text between block-level tags, with their open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
HIDDEN = frozenset("script style title noscript template iframe select noembed noframes".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FOREIGN = ("svg", "math")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr object output q rp rt"
    " ruby s samp small span strike strong sub sup svg time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.DOTALL)
_ATTRIBUTES = re.compile(r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE) for tag in RAW}
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Open:
    """An open element. All blocks inside it share it and, through it, the elements around it."""

    __slots__ = ("tag", "words", "around", "depth", "fresh")

    def __init__(self, tag: str, words: tuple[str, ...], around: Open | None, fresh: tuple[str, ...]):
        self.tag, self.words, self.around = tag, words, around  # words of its class, id and role
        self.depth = around.depth + 1 if around else 1
        self.fresh = fresh  # "in tag" and "named word" as far as no element around has them


@dataclass
class Block:
    text: str
    tag: str  # innermost block-level element
    inner: Open | None  # innermost open element
    linked: float  # share of the text that is inside links

    def opened(self) -> list[Open]:
        """The open elements, outermost first."""
        out, at = [], self.inner
        while at:
            out.append(at)
            at = at.around
        return out[::-1]


class Stack:
    """The open elements of a place in a page; every question about them takes constant time."""

    def __init__(self):
        self.held: list[Open] = []
        self.blocks: list[int] = []  # places of the block-level ones
        self.places: dict[str, list[int]] = {}  # by tag
        self.named: dict[str, int] = {}  # how many hold each word

    def last(self, tags) -> int:
        """Place of the innermost element of one of ``tags``, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def top(self) -> Open | None:
        return self.held[-1] if self.held else None

    def block_tag(self) -> str:
        return self.held[self.blocks[-1]].tag if self.blocks else "body"

    def push(self, tag: str, words: tuple[str, ...], block: bool) -> None:
        places = self.places.setdefault(tag, [])
        words = tuple(dict.fromkeys(words))
        fresh = [] if places else [f"in {tag}"]
        fresh += [f"named {w}" for w in words if not self.named.get(w)]
        for w in words:
            self.named[w] = self.named.get(w, 0) + 1
        places.append(len(self.held))
        if block:
            self.blocks.append(len(self.held))
        self.held.append(Open(tag, words, self.top(), tuple(fresh)))

    def cut(self, to: int) -> list[str]:
        """Closes the elements from place ``to`` on; returns their tags."""
        gone = self.held[to:]
        del self.held[to:]
        for element in gone:
            self.places[element.tag].pop()
            for w in element.words:
                self.named[w] -= 1
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
        return [element.tag for element in gone]


def _words_of(attributes: str) -> tuple[str, ...]:
    found = []
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                found.append("hidden")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            found.append("hidden")
        elif name in ("class", "id", "role"):
            found += [w.lower() for w in _PART.findall(value)]
    return tuple(found)


def chain(path: tuple[str, ...], words: tuple[str, ...]) -> Open | None:
    """The open elements of a path, the innermost with ``words``."""
    stack = Stack()
    for k, tag in enumerate(path):
        stack.push(tag, words if k == len(path) - 1 else (), tag not in INLINE)
    return stack.top()


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; text of elements that are never shown is left out.

    End tags that match nothing are ignored, elements left open end with their parent, a paragraph ends
    where a block-level element starts, and the head at the first element or text that cannot be in it.
    A tag whose quotes do not end before the next ``<`` ends at the next ``>``, quoted or not. White
    space inside a block becomes one blank. The time is proportional to the page, however deep it nests.
    """
    out: list[Block] = []
    stack = Stack()
    parts: list[tuple[str, bool]] = []
    hidden = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                inside = sum(len(p.strip()) for p, linked in parts if linked)
                out.append(Block(text, stack.block_tag(), stack.top(), min(1.0, inside / len(text))))
            parts.clear()

    def pop(to: int) -> None:
        nonlocal hidden
        if stack.blocks and stack.blocks[-1] >= to:
            flush()
        hidden -= sum(t in HIDDEN for t in stack.cut(to))

    def add(raw: str) -> None:
        if raw and not hidden:
            if stack.last(("head",)) >= 0 and not raw.isspace():
                pop(stack.last(("head",)))
            parts.append((html.unescape(raw) if "&" in raw else raw, stack.last("a") >= 0))

    at = plain_until = 0
    while at < len(page):
        found = _MARK.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        closing, tag = found.group(1), found.group(2)
        if not tag:
            continue
        end = at if at < plain_until else _ATTRIBUTES.match(page, at).end()
        if page[end : end + 1] == ">":
            attributes = page[at:end]
        else:
            plain_until = max(plain_until, end)
            attributes, end = "", page.find(">", at)
        at = end + 1 if end >= 0 else len(page)
        tag = tag.lower()
        foreign = stack.last(FOREIGN) >= 0
        inline = foreign or tag in INLINE
        if closing:
            place = stack.last((tag,))
            if not inline:
                flush()
            if place >= 0:
                pop(place)
            continue
        if tag == "br":
            parts.append((" ", False))
            continue
        if tag not in IN_HEAD and tag != "head" and stack.last(("head",)) >= 0:
            pop(stack.last(("head",)))
        if tag in ("html", "head", "body") and (stack.last(("body", tag)) >= 0 or (tag != "body" and len(stack.held) > (tag == "head"))):
            continue  # only the first of each is an element, and only where it can stand
        if not inline:
            flush()
        if tag in ENDS_PARAGRAPH and stack.last("p") >= 0:
            pop(stack.last("p"))
        if tag in SAME_LEVEL:
            place = stack.last(SAME_LEVEL[tag])
            if place > stack.last(STOPS[tag]):
                pop(place)
        if tag in VOID:
            continue
        if tag in RAW and not (foreign and tag != "script" and tag != "style" and tag != "title"):
            # Nothing inside is markup until the end tag.
            raw_end = _RAW_END[tag].search(page, at)
            if tag not in HIDDEN:
                stack.push(tag, _words_of(attributes), True)
                add(page[at : raw_end.start() if raw_end else len(page)])
                pop(len(stack.held) - 1)
            at = raw_end.end() if raw_end else len(page)
            continue
        if tag == "body" and stack.held:  # whatever was open before it
            pop(int(stack.held[0].tag == "html"))
        if not (attributes.rstrip().endswith("/") and (foreign or tag in FOREIGN)):
            stack.push(tag, _words_of(attributes) if attributes.strip() else (), not inline)
            hidden += tag in HIDDEN
    flush()
    return out

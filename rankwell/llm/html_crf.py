"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each block is main text or not. State weights belong to hashed features of its open elements, of the
words in their classes and ids, and of its text; transition weights to neighbouring labels. Training
maximises the likelihood of labelled pages by forward-backward; pages are decoded by Viterbi.

Labelled pages come from the table itself: pages that mark their article say which blocks are in it.
Their blocks are also set into other layouts, where the label is known and the mark is gone, so that
the field learns from classes, positions and text as well.
"""

from __future__ import annotations

import functools
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import whole_text
from rankwell.llm.html_blocks import Block, Open, blocks_of, chain

TRAIN_PAGES = 400  # pages the field is trained on, at most about
TRAIN_BLOCKS = 60  # pages of more blocks are trained on in stretches of so many
TRAIN_DEPTH = 200  # pages that nest deeper are not trained on
SHORT = 8  # words of blocks of at most so many are features
CELLS = 1 << 14
EPOCHS = 6
RATE = 0.15

# Element names and class words of the article, and of parts that are not the article.
MARKS = frozenset(("article", "main"))
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog button".split())
OUTSIDE_WORDS = (
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal"
    " overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail widget footer header masthead topbar"
    " toolbar comment comments reply replies respond discussion disqus form login signup subscribe newsletter search"
    " share sharing social related recommended recommendations more popular trending tags pager pagination copyright"
    " legal disclaimer skip toc hidden"
).split()
INSIDE_WORDS = "article content main post entry body story text page wrapper container single hentry prose".split()
# Short texts of such parts, beside those that the pages bring.
OUTSIDE_TEXTS = (
    "Home|About us|Contact|Log in|Sign up|Subscribe to our newsletter|We use cookies to improve your experience.|"
    "Accept all|Advertisement|Sponsored|Share this|Follow us|Related posts|Read more|Leave a reply|3 comments|"
    "Great post, thanks!|I do not agree with this at all.|All rights reserved.|Privacy policy|Terms of use|"
    "Skip to content|Search|Enter your e-mail|Previous|Next|Back to top|Most popular|Tags|Posted by admin"
).split("|")


@functools.lru_cache(maxsize=200_000)
def _cell(name: str) -> int:
    return zlib.crc32(name.encode()) % CELLS


_OUTSIDE = frozenset(OUTSIDE_WORDS)
_FLAGS = ("outside tag", "outside word", "inside tag")


def _flags(element: Open) -> list[str]:
    held = (element.tag in OUTSIDE_TAGS, not _OUTSIDE.isdisjoint(element.words), element.tag in MARKS)
    return [name for name, flag in zip(_FLAGS, held) if flag]


def _own_names(blocks: list[Block]) -> list[list[str]]:
    """Features of every block of a page beside those that all of its open elements give."""
    out = []
    sizes = []
    for k, block in enumerate(blocks):
        words = block.text.split()
        letters = sum(map(len, words))
        sizes.append(min(len(words).bit_length(), 9))
        names = {f"tag {block.tag}", f"words {sizes[-1]}", f"linked {int(block.linked * 4)}", "bias"}
        at = block.inner
        for _ in range(3):
            if at:
                names.add(f"near {at.tag}")
                at = at.around
        names.add(f"ends {block.text[-1] if block.text[-1] in '.!?:,|' else 'no'}")
        names.add(f"mean {min(letters // max(len(words), 1), 12)}")
        names.add(f"place {'first' if k < 2 else 'last' if k >= len(blocks) - 2 else 'mid'}")
        if len(words) <= SHORT:
            names.update(f"says {w.lower().strip('.,:;!?')}" for w in words)
        if any(w.isdigit() for w in words):
            names.add("number")
        if "©" in block.text or "copyright" in block.text.lower():
            names.add("copyright")
        out.append(names)
    for k, names in enumerate(out):  # what stands before and after
        names.add(f"after {sizes[k - 1] if k else 'start'}")
        names.add(f"before {sizes[k + 1] if k + 1 < len(out) else 'end'}")
    return [sorted(names) for names in out]


def features(blocks: list[Block]) -> list[np.ndarray]:
    """Hashed features of every block, those of its open elements with them; for pages of bounded depth."""
    out = []
    for block, names in zip(blocks, _own_names(blocks)):
        opened = block.opened()
        above = [n for e in opened for n in e.fresh] + sorted({n for e in opened for n in _flags(e)})
        out.append(np.array([_cell(n) for n in names + above], np.int64))
    return out


def own_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its article or main part; None for other pages."""
    paths = [block.opened() for block in blocks]
    first = [next((k for k, e in enumerate(p) if e.tag in MARKS), len(p)) for p in paths]
    if all(k == len(p) for k, p in zip(first, paths)):
        return None
    outside = [
        any(e.tag in OUTSIDE_TAGS - {"header"} for e in p[k:]) or any(not _OUTSIDE.isdisjoint(e.words) for e in p)
        for k, p in zip(first, paths)
    ]
    return np.array([k < len(p) and not o for k, p, o in zip(first, paths, outside)], np.int64)


def relaid(kept: list[str], others: list[str], rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """The same texts in another layout, with its labels."""
    blocks, labels = [], []
    bare = rng.random() < 0.3  # a layout without a word on what its parts are
    kinds = [("div",), ("div", "div"), ("main",), ("section",), ("article",), ("div", "article")]
    outer = rng.choice(kinds[:2] if bare else kinds)
    outer_names = () if bare else tuple(rng.sample(INSIDE_WORDS, rng.randint(0, 2)))

    def outside(where: tuple[str, ...], names: tuple[str, ...]) -> None:
        for _ in range(rng.randint(1, 4)):
            text = rng.choice(others + list(OUTSIDE_TEXTS))
            kind = rng.choice([(), ("ul", "li"), ("p",), ("div",), ("ul", "li", "a"), ("span",)])
            tag, word = rng.choice([("div", True), ("section", True), (rng.choice(sorted(OUTSIDE_TAGS)), rng.random() < 0.5)])
            if bare:
                tag, word = "div", False
            path = ("html", "body", *where, tag, *kind)
            given = (*names, *((rng.choice(OUTSIDE_WORDS),) if word else ()))
            inner = next((t for t in reversed(path) if t not in ("a", "span")), "body")
            blocks.append(Block(text, inner, chain(path, given), float("a" in kind)))
            labels.append(0)

    for _ in range(rng.randint(1, 3)):
        outside((), ())
    for k, text in enumerate(kept):
        tag = "h1" if k == 0 and len(text) < 120 else rng.choice(["p", "p", "p", "p", "li", "h2", "blockquote", "div", "td"])
        deep = {"li": ("ul",), "td": ("table", "tr")}.get(tag, ())
        path = ("html", "body", *outer, *deep, tag)
        blocks.append(Block(text, tag, chain(path, outer_names), 0.0 if rng.random() < 0.9 else rng.random() * 0.4))
        labels.append(1)
        if rng.random() < 0.08:
            outside(outer, outer_names)
    if not bare and rng.random() < 0.5:  # comments of readers look like text
        for _ in range(rng.randint(1, 4)):
            where = outer if rng.random() < 0.5 else ()
            word = rng.choice(["comment", "comments", "reply", "respond", "discussion"])
            path = ("html", "body", *where, rng.choice(["div", "section", "ol"]), "p")
            given = (*outer_names, word) if where else (word,)
            blocks.append(Block(rng.choice(kept or list(OUTSIDE_TEXTS)), "p", chain(path, given), 0.0))
            labels.append(0)
    for _ in range(rng.randint(1, 3)):
        outside((), ())
    return blocks, np.array(labels, np.int64)


class Field:
    """State weights by feature and label, transitions, and weights of the first and last label."""

    def __init__(self):
        self.state = np.zeros((CELLS, 2))
        self.step = np.zeros((2, 2))
        self.edge = np.zeros((2, 2))  # first, last

    def scores(self, cells: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(c) for c in cells])
        return np.add.reduceat(self.state[np.concatenate(cells)], np.cumsum(sizes) - sizes, axis=0)

    @functools.cached_property
    def _weights(self) -> list[list[float]]:
        return self.state.tolist()

    def page_scores(self, blocks: list[Block]) -> np.ndarray:
        """The scores of ``features(blocks)`` for a trained field; those of an open element are summed once
        for all its blocks."""
        weights = self._weights
        above: dict[int, tuple[float, float, frozenset[str]]] = {0: (0.0, 0.0, frozenset())}
        out = np.empty((len(blocks), 2))
        for k, (block, names) in enumerate(zip(blocks, _own_names(blocks))):
            new, at = [], block.inner
            while at and id(at) not in above:
                new.append(at)
                at = at.around
            s0, s1, flags = above[id(at) if at else 0]
            for element in reversed(new):
                added = [*element.fresh, *(f for f in _flags(element) if f not in flags)]
                for w0, w1 in (weights[_cell(n)] for n in added):
                    s0, s1 = s0 + w0, s1 + w1
                flags = flags.union(added).intersection(_FLAGS) if added else flags
                above[id(element)] = (s0, s1, flags)
            own = [weights[_cell(n)] for n in names]
            out[k] = s0 + sum(w[0] for w in own), s1 + sum(w[1] for w in own)
        return out

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The likeliest labels of the blocks with these scores, by Viterbi."""
        best = (scores[0] + self.edge[0]).tolist()
        (a00, a01), (a10, a11) = self.step.tolist()
        back = []
        for s0, s1 in scores[1:].tolist():
            from0, from1 = (best[0] + a00 < best[1] + a10), (best[0] + a01 < best[1] + a11)
            back.append((int(from0), int(from1)))
            best = [s0 + max(best[0] + a00, best[1] + a10), s1 + max(best[0] + a01, best[1] + a11)]
        label = int(best[0] + self.edge[1, 0] < best[1] + self.edge[1, 1])
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return np.array(labels[::-1])

    def expected(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each block's label, and the expected number of each transition."""
        n = len(scores)
        ahead, behind = np.empty((n, 2)), np.empty((n, 2))
        ahead[0], behind[-1] = scores[0] + self.edge[0], self.edge[1]
        for k in range(1, n):
            ahead[k] = scores[k] + np.logaddexp(ahead[k - 1, 0] + self.step[0], ahead[k - 1, 1] + self.step[1])
        for k in range(n - 2, -1, -1):
            after = scores[k + 1] + behind[k + 1]
            behind[k] = np.logaddexp(self.step[:, 0] + after[0], self.step[:, 1] + after[1])
        whole = np.logaddexp(*(ahead[-1] + behind[-1]))
        single = np.exp(ahead + behind - whole)
        pairs = np.zeros((2, 2))
        if n > 1:
            pairs = np.exp(ahead[:-1, :, None] + self.step + (scores[1:] + behind[1:])[:, None, :] - whole).sum(axis=0)
        return single, pairs

    @classmethod
    def train(cls, pages: list[tuple[list[np.ndarray], np.ndarray]]) -> Field:
        """Likelihood ascent by AdaGrad, page by page."""
        field = cls()
        seen, seen_step, seen_edge = np.full((CELLS, 2), 1e-4), np.full((2, 2), 1e-4), np.full((2, 2), 1e-4)
        order = np.random.default_rng(3)
        for _ in range(EPOCHS):
            for at in order.permutation(len(pages)):
                cells, labels = pages[at]
                single, pairs = field.expected(field.scores(cells))
                truth = np.eye(2)[labels]
                flat = np.concatenate(cells)
                delta = np.repeat(truth - single, [len(c) for c in cells], axis=0)
                some, back = np.unique(flat, return_inverse=True)
                slope = np.zeros((len(some), 2))
                np.add.at(slope, back, delta)
                slope -= 1e-3 * field.state[some]
                seen[some] += slope**2
                field.state[some] += RATE * slope / np.sqrt(seen[some])
                moved = np.zeros((2, 2))
                np.add.at(moved, (labels[:-1], labels[1:]), 1)
                slope = moved - pairs
                seen_step += slope**2
                field.step += RATE * slope / np.sqrt(seen_step)
                slope = np.stack((truth[0] - single[0], truth[-1] - single[-1]))
                seen_edge += slope**2
                field.edge += RATE * slope / np.sqrt(seen_edge)
        return field


def training_pages(pages: list[str]) -> list[tuple[list[Block], np.ndarray]]:
    """Labelled sequences: pages that mark their article, and each of them in two other layouts."""
    rng = random.Random(7)
    out: list[tuple[list[Block], np.ndarray]] = []
    for page in pages:
        blocks = blocks_of(page)
        if not blocks or max(b.inner.depth if b.inner else 0 for b in blocks) > TRAIN_DEPTH:
            continue
        labels = own_labels(blocks)
        if labels is None:
            continue
        kept = [b.text for b, y in zip(blocks, labels) if y]
        others = [b.text for b, y in zip(blocks, labels) if not y]
        out.append((blocks, labels))
        for _ in range(2):
            out.append(relaid(kept[:TRAIN_BLOCKS], others, rng))
    if not out:  # a table without marked pages: the layouts with short texts of their own
        filling = ["A first paragraph of some words that say a little more than a label does.", "And a second one, also longer."]
        out = [relaid(filling * rng.randint(1, 3), [], rng) for _ in range(60)]
    return out


def fit(pages: DataFrame, rows: int = TRAIN_PAGES, text: str = "html") -> Field:
    """Trains on at most about ``rows`` pages, those of smallest hash, so the whole table has a part."""
    total = pages.count()
    spot = F.pmod(F.xxhash64(text), F.lit(1 << 30))
    drawn = pages.where(spot < int(min(1.0, rows / max(total, 1)) * (1 << 30))).select(whole_text(text).alias("html"))
    held = drawn.select("html", F.xxhash64("html").alias("h")).distinct().orderBy("h").limit(2 * rows).toArrow()
    ready = []
    for blocks, labels in training_pages(held["html"].to_pylist()):
        cells = features(blocks)
        for start in range(0, len(blocks), TRAIN_BLOCKS):
            ready.append((cells[start : start + TRAIN_BLOCKS], labels[start : start + TRAIN_BLOCKS]))
    return Field.train(ready)


def main_text(page: str, field: Field) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    return "\n".join(b.text for b, keep in zip(blocks, field.decode(field.page_scores(blocks))) if keep)


def extract(pages: DataFrame, rows: int = TRAIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The whole page is read; null pages count as empty and give an empty text, as do pages without a
    block of main text. Repeated rows each give a row, null keys are kept, an empty table gives an empty
    result. Other columns are not read.
    """
    field = pages.sparkSession.sparkContext.broadcast(fit(pages, rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), field.value) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    whole = pages.select("page_id", "url", whole_text("html").alias("html"))
    kind = whole.schema["page_id"].dataType.simpleString()
    return whole.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")

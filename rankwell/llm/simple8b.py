"""Simple-8b: integers packed into 64-bit words, encoded and decoded block by block in numpy.

A word holds a selector in its top four bits and values of equal width below. Values of 60 bits and
more follow an escape word as a raw word. Blocks start on a word, so all blocks of a page are coded
side by side, and any block can be decoded alone from its offset.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024  # integers per block

# Fixed values of the format: values per word and bits per value, by selector. Selector 15 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15

_SHORT = np.maximum(np.frexp(np.arange(1 << 16, dtype=np.float64))[1], 1).astype(np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned 64-bit integer, 1 for zero."""
    if values.size and values.max() < len(_SHORT):
        return _SHORT[values]
    high = values >> np.uint64(32)
    low = values & np.uint64(0xFFFFFFFF)
    bits = np.frexp(np.where(high > 0, high, low).astype(np.float64))[1].astype(np.uint8)
    bits += np.where(high > 0, 32, 0).astype(np.uint8)
    return np.maximum(bits, 1)


def _window_max(bits: np.ndarray) -> dict[int, np.ndarray]:
    """The largest width among the next c values, for every count c of the format."""
    known, width = {1: bits}, bits.shape[1]
    for c in sorted(COUNTS)[1:]:
        part = max(k for k in known if k < c)
        # Two windows of ``part`` cover one of ``c`` when they overlap or touch.
        while 2 * part < c:
            wide = known[part].copy()
            np.maximum(wide[:, : width - part], known[part][:, part:], out=wide[:, : width - part])
            known[2 * part] = wide
            part *= 2
        wide = known[part].copy()
        np.maximum(wide[:, : width - (c - part)], known[part][:, c - part :], out=wide[:, : width - (c - part)])
        known[c] = wide
    return known


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the coded words and the first word of every block."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    row = BLOCK + COUNTS[0]  # a word that reaches beyond its block is filled with zeros
    padded = np.zeros((blocks, row), np.uint64)
    whole = n // BLOCK
    padded[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        padded[whole, : n - whole * BLOCK] = values[whole * BLOCK :]
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    take = np.zeros((blocks, row), np.uint8)  # 0: escape
    wide = _window_max(bit_lengths(padded))
    for count, width in zip(COUNTS[::-1], WIDTHS[::-1]):
        np.copyto(take, count, where=wide[count] <= width)

    # All blocks advance together, one word each.
    take, padded = take.ravel(), padded.ravel()
    used = np.zeros(blocks, np.int64)
    heads, counts, owners, locals_ = [], [], [], []
    alive, at = np.arange(blocks), np.arange(blocks) * row
    stop = at + lengths
    while len(alive):
        count = take[at]
        heads.append(at)
        counts.append(count)
        owners.append(alive)
        locals_.append(used[alive])
        used[alive] += 1 + (count == 0)
        at = at + np.maximum(count, 1)
        more = at < stop
        if not more.all():
            alive, at, stop = alive[more], at[more], stop[more]
    heads, counts = np.concatenate(heads), np.concatenate(counts)
    offsets = np.cumsum(used) - used
    place = offsets[np.concatenate(owners)] + np.concatenate(locals_)
    words = np.zeros(int(used.sum()), np.uint64)
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        chosen = np.flatnonzero(counts == count)
        if len(chosen):
            source, packed = heads[chosen], np.full(len(chosen), selector << 60, np.uint64)
            for k in range(count):
                packed |= padded[source + k] << np.uint64(k * width)
            words[place[chosen]] = packed
    escaped = np.flatnonzero(counts == 0)
    words[place[escaped]] = np.uint64(ESCAPE << 60)
    words[place[escaped] + 1] = padded[heads[escaped]]
    return words, offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers behind ``words``."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    raw = _raw_words(selectors)
    heads = np.flatnonzero(~raw)
    selectors = selectors[heads]
    counts = np.ones(len(heads), np.int64)
    for selector, count in enumerate(COUNTS):
        counts[selectors == selector] = count
    # Where each word's values start: counted from the start of its block, which may end inside a word.
    block = np.searchsorted(offsets, heads, side="right") - 1
    before = np.cumsum(counts) - counts
    first = np.searchsorted(heads, offsets)
    starts = before - before[first][block] + block * BLOCK
    ends = np.minimum((block + 1) * BLOCK, n)
    for selector, (count, width) in enumerate(zip(COUNTS, WIDTHS)):
        chosen = np.flatnonzero(selectors == selector)
        if len(chosen):
            held, at, end = words[heads[chosen]], starts[chosen], ends[chosen]
            cut = at + count > end  # the last word of a block may hold filling
            for part, inside in ((~cut, None), (cut, end)):
                if not part.any():
                    continue
                word, target = held[part], at[part]
                for k in range(count):
                    value = (word >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
                    if inside is None:
                        out[target + k] = value
                    else:
                        fits = target + k < end[part]
                        out[target[fits] + k] = value[fits]
    escaped = np.flatnonzero(selectors == ESCAPE)
    out[starts[escaped]] = words[heads[escaped] + 1]
    return out


def _raw_words(selectors: np.ndarray) -> np.ndarray:
    """Which words are raw values behind an escape; a raw word may look like an escape itself."""
    raw = np.zeros(len(selectors), bool)
    marks = np.flatnonzero(selectors == ESCAPE)
    if len(marks):
        # Within a run of marked words every second one is an escape; the word behind it is raw.
        run = np.concatenate(([True], np.diff(marks) > 1))
        begin = np.maximum.accumulate(np.where(run, np.arange(len(marks)), 0))
        escapes = marks[(np.arange(len(marks)) - begin) % 2 == 0]
        raw[escapes + 1] = True
    return raw

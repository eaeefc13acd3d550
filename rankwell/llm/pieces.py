"""Pre-tokens of byte-level BPE and their counts over a corpus.

A blank that follows no other white space starts a new pre-token, so texts are cut there first. The
cuts of many texts hold few distinct chunks, and only these are matched against the pattern.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import give_back, whole_text

FLUSH = 200_000  # distinct pre-tokens a task holds before it hands them on
AT_ONCE = 8_000_000  # bytes of text cut together

_CUT = "\x1f"
_UNCUT = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}] |\x{1f}"  # texts that are matched whole


@functools.cache
def _matcher(pattern: str):
    return regex.compile(pattern)


def split_pieces(text: str) -> list[str]:
    """The pre-tokens of a text; together they are the text."""
    return _matcher(public_tokenizers.PATTERN).findall(text)


_MARKS = frozenset(".,;:!?")


def split_chunk(chunk: str) -> list[str]:
    """``split_pieces``, without the pattern for a blank with letters, and perhaps one mark, behind it."""
    if chunk[:1] == " ":
        if chunk[1:].isalpha():
            return [chunk]
        if chunk[-1] in _MARKS and chunk[1:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
    return split_pieces(chunk)


_WORD = "^ [A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]?$"  # a blank and letters, and perhaps one mark behind them
_MARKED = "[.,;:!?]$"


def strings(column: pa.StringArray) -> list[str]:
    """``to_pylist`` of a column without nulls, by way of numpy, which is faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def split_chunks(
    chunks: pa.StringArray, split: Callable[[str], list[str]] = split_chunk, special: tuple[str, ...] = ()
) -> tuple[pa.StringArray, np.ndarray]:
    """(the pre-tokens of all chunks end to end, how many each chunk has).

    Words are cut by Arrow; other chunks, and those with a special string in them, by ``split``.
    """
    word = pc.match_substring_regex(chunks, _WORD)
    for mark in special:
        word = pc.and_not(word, pc.match_substring(chunks, mark))
    marked = pc.and_(word, pc.match_substring_regex(chunks, _MARKED))
    bare = np.flatnonzero(pc.and_not(word, marked).to_numpy(zero_copy_only=False))
    rest = np.flatnonzero(pc.invert(word).to_numpy(zero_copy_only=False))
    marked = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
    both = chunks.take(pa.array(marked))
    others = [split(c) for c in strings(chunks.take(pa.array(rest)))]
    pool = [chunks.take(pa.array(bare)), pc.utf8_slice_codeunits(both, 0, -1), pc.utf8_slice_codeunits(both, -1)]
    pool.append(pa.array([p for pieces in others for p in pieces], chunks.type))
    starts, sizes = np.empty(len(chunks), np.int64), np.ones(len(chunks), np.int64)
    # Places in the pool: a word, or a word and a mark that stands ``len(marked)`` further, or a stretch.
    starts[bare] = np.arange(len(bare))
    starts[marked] = len(bare) + np.arange(len(marked))
    sizes[rest] = [len(pieces) for pieces in others]
    starts[rest] = len(bare) + 2 * len(marked) + np.cumsum(sizes[rest]) - sizes[rest]
    sizes[marked] = 2
    places = gather(np.arange(sum(map(len, pool))), starts, sizes)
    seconds = (np.cumsum(sizes) - sizes)[marked] + 1
    places[seconds] = len(bare) + len(marked) + np.arange(len(marked))
    return pa.concat_arrays(pool).take(pa.array(places)), sizes


def slices(batch: pa.RecordBatch, column: str, at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``at_once`` bytes of text each, one row at least."""
    reach = np.cumsum(pc.binary_length(batch.column(column)).to_numpy().astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = reach[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(reach, before + at_once, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def chunk_texts(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(distinct chunks, chunk of each place, first place of each text).

    The chunks of a text are the text, every text has one at least, and no pre-token crosses a cut.
    """
    plain = pc.invert(pc.match_substring_regex(texts, _UNCUT))
    cut = pc.split_pattern(pc.replace_substring(pc.if_else(plain, texts, ""), " ", _CUT + " "), _CUT)
    if pc.all(plain).as_py() is False:
        # Texts with other white space before a blank, or with the mark itself, are one chunk each.
        sizes = np.ones(len(texts), np.int32)
        whole = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), texts)
        cut = pc.if_else(plain, cut, whole)
    lists = cut
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return coded.dictionary, coded.indices.to_numpy(), offsets[:-1]


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches values[start : start + size], end to end."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def piece_counts(
    docs: DataFrame,
    split: Callable[[pa.StringArray], tuple[pa.StringArray, np.ndarray]] = split_chunks,
    text: str = "text",
) -> DataFrame:
    """(piece, n) over all documents: counted inside each task first, then summed by piece."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list[pa.Table]) -> pa.Table:
            sums = pa.concat_tables(parts).group_by("piece", use_threads=False).aggregate([("n", "sum")])
            return sums.select(["piece", "n_sum"]).rename_columns(["piece", "n"])

        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, "text"):
                chunks, places, _ = chunk_texts(part.column("text"))
                pieces, sizes = split(chunks)
                times = np.repeat(np.bincount(places, minlength=len(chunks)), sizes)
                held.append(pa.table({"piece": pieces, "n": pa.array(times, pa.int64())}))
                if sum(t.num_rows for t in held) >= FLUSH:
                    held = [summed(held)]
                    if held[0].num_rows >= FLUSH:
                        # Neighbours share beginnings, which compresses the shuffle.
                        yield from held[0].sort_by("piece").combine_chunks().to_batches()
                        held = []
        if held:
            yield from summed(held).sort_by("piece").combine_chunks().to_batches()
        held = []
        give_back()

    counted = docs.select(whole_text(text).alias("text")).mapInArrow(count, "piece string, n long")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))

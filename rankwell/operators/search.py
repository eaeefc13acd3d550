"""Keyword search over records: words, phrases, ``or`` and exclusions.

The text is reduced once per row to lower-case words set apart by single blanks, and every
condition is a substring test on it, so a search is one scan without joins. Words are compared
as written there. ``stem_index`` holds the places of each word stem in each record, and
``search_stems`` answers the same search texts from it, inflected words included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.functions.stems import stem

SLICE_BYTES = 4 << 20  # of texts that are indexed together in a Python worker
_BLANKED = np.full(256, ord(" "), np.uint8)  # bytes of words stay, any other is a blank
_BLANKED[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = list(b"abcdefghijklmnopqrstuvwxyz0123456789")

# --- fixed values: English stop words ------------------------------------------------------------
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom this
    that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through
    during before after above below to from up down in out on off over under again further then
    once here there when where why how all any both each few more most other some such no nor not
    only own same so than too very s t can will just don should now""".split()
)
_PART = re.compile(r'-?"[^"]*"|\S+')


def word_text(*columns: Column) -> Column:
    """`` word word word `` of the joined columns."""
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    return F.concat(
        F.lit(" "), F.trim(F.regexp_replace(F.lower(joined), "[^a-z0-9]+", " ")), F.lit(" ")
    )


def matches(words: Column, search: str) -> Column:
    """Condition for a search text; null-free, true for a search without usable words."""
    groups: list[list[Column]] = [[]]
    for part in _PART.findall(search):
        if part.lower() == "or":
            groups.append([])
            continue
        terms = re.findall(r"[a-z0-9]+", part.lower())
        quoted = '"' in part
        if not quoted:
            terms = [w for w in terms if w not in STOP_WORDS]
        if not terms or (quoted and set(terms) <= STOP_WORDS):
            continue
        found = words.contains(" " + " ".join(terms) + " ")
        groups[-1].append(~found if part.startswith("-") else found)
    sides = [reduce(lambda a, b: a & b, g) for g in groups if g]
    return reduce(lambda a, b: a | b, sides) if sides else F.lit(True)


def search_records(records: DataFrame, search: str, columns: list[str]) -> DataFrame:
    return records.where(matches(word_text(*[F.col(c) for c in columns]), search))


# --- by word stems --------------------------------------------------------------------------------


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, lower-case text): a row for each stem of each record, with its places."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            yield _slice_postings(batch.slice(start, stop - start))
            start = stop


def _words(texts: pa.Array) -> pa.Array:
    """Lists of the runs of a-z and 0-9 of each text; a blank at an end gives an empty one."""
    texts = texts.cast(pa.string())
    _, ends, held = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    blanked = _BLANKED[np.frombuffer(held or b"", np.uint8)[ends[0] : ends[-1]]]
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(blanked))
    return pc.ascii_split_whitespace(plain)


def _slice_postings(part: pa.RecordBatch) -> pa.RecordBatch:
    lists = _words(part.column(1))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    record, flat = np.repeat(np.arange(len(sizes)), sizes), lists.flatten()
    before = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)])
    place = before[:-1] - np.repeat(before[np.cumsum(sizes) - sizes], sizes)
    coded = flat.dictionary_encode()
    # Each distinct word is stemmed once; blanks and stop words have no stem.
    found = [stem(w) if w and w not in STOP_WORDS else None for w in coded.dictionary.to_pylist()]
    listed = sorted(set(found) - {None})
    number = {s: k for k, s in enumerate(listed)} | {None: len(listed)}
    code = np.array([number[s] for s in found], np.min_scalar_type(len(listed)))[coded.indices.to_numpy()]
    order = np.argsort(code, kind="stable")  # by stem, then as they stand
    order = order[: np.count_nonzero(code < len(listed))]
    code, record, place = code[order], record[order], place[order]
    new = np.flatnonzero(np.diff(code, prepend=-1).astype(bool) | np.diff(record, prepend=-1).astype(bool))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(listed, pa.string()).take(pa.array(code[new], pa.int64())),
            part.column(0).take(pa.array(record[new], pa.int64())),
            pa.ListArray.from_arrays(np.append(new, len(place)).astype(np.int32), pa.array(place, pa.int32())),
        ],
        names=["stem", part.schema.names[0], "places"],
    )


def stem_index(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(stem, key, places): where each stem stands in each record, stop words left out but counted.

    ``key`` names the column that tells records apart; rows that repeat one each have their own rows here.
    A task indexes the records it reads and nothing is shuffled: every part is sorted by stem, so that a
    search of the written table reads the pages of its stems, and a common stem spans all parts.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])).alias("_text")
    kind = records.schema[key].dataType.simpleString()
    rows = records.select(F.col(key), text).mapInArrow(_postings, f"stem string, `{key}` {kind}, places array<int>")
    return rows.sortWithinPartitions("stem", key)


def _stem_groups(search: str) -> list[list[tuple[bool, list[tuple[int, str]]]]]:
    """Alternatives of (wanted, [(offset, stem)]); stop words are left out, their offsets stay."""
    groups: list[list[tuple[bool, list[tuple[int, str]]]]] = [[]]
    for part in _PART.findall(search):
        if part.lower() == "or":
            groups.append([])
            continue
        terms = [
            (k, stem(w)) for k, w in enumerate(re.findall(r"[a-z0-9]+", part.lower())) if w not in STOP_WORDS
        ]
        if terms:
            groups[-1].append((not part.startswith("-"), terms))
    return [g for g in groups if g]


def search_stems(records: DataFrame, index: DataFrame, search: str, key: str) -> DataFrame:
    """The records that match a search text by stems; all records for one without usable words.

    Terms of one word ask for the stem, phrases for their stems at the same distances. Only the
    postings of the stems asked for are read, and meet per record. Records without a key are found only
    by a search without usable words.
    """
    groups = _stem_groups(search)
    if not groups:
        return records
    asked = sorted({s for g in groups for _, terms in g for _, s in terms})
    hits = index.where(F.col("stem").isin(asked)).groupBy(key).agg(
        *[F.flatten(F.collect_list(F.when(F.col("stem") == s, F.col("places")))).alias(f"_{k}") for k, s in enumerate(asked)]
    )
    places = {s: F.col(f"_{k}") for k, s in enumerate(asked)}

    def stands(terms: list[tuple[int, str]]) -> Column:
        first, lead = terms[0]
        if len(terms) == 1:
            return F.size(places[lead]) > 0
        rest = [(offset - first, places[s]) for offset, s in terms[1:]]
        return F.coalesce(
            F.exists(places[lead], lambda p: reduce(lambda a, b: a & b, [F.array_contains(at, p + d) for d, at in rest])),
            F.lit(False),
        )

    sides = [reduce(lambda a, b: a & b, [stands(t) if wanted else ~stands(t) for wanted, t in g]) for g in groups]
    matched = reduce(lambda a, b: a | b, sides)
    if all(any(wanted for wanted, _ in g) for g in groups):
        return records.join(hits.where(matched).select(key), key, "left_semi")
    # Exclusions alone also hold for records without any of the stems.
    return records.join(hits.where(~matched).select(key), key, "left_anti").where(F.col(key).isNotNull())

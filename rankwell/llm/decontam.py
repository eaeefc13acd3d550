"""Benchmark decontamination: BM25 over test items, searched by every passage with block-max WAND.

Test items are cut into units of at most ``UNIT`` words and indexed by word. Impacts are BM25 weights
divided by the unit's own total, so a passage that holds a unit whole scores 1. The index is cut into
shards of bounded size; each goes to the tasks that read the documents, one pass per shard.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut_lineage, give_back, whole_text

UNIT = 64  # words of an item that are indexed together
STRIDE = 64  # a passage is two strides, so any 64 words in a row lie inside one
THRESHOLD = 0.5  # score from which a unit is retrieved
QUESTION, ANSWER = 0.6, 0.5  # shares of word trigrams that must be in the passage
NGRAM = 3
JUDGED = 8  # trigrams from which the question or the answer of a unit is judged by itself
BLOCK = 32  # postings per block
SPAN = 1  # units that share a bound in the first test
SHARD_WORDS = 1_000_000  # words of a shard: bounds what is broadcast
REST = 0.15  # the most that terms outside the first test may add to a unit
K1, B = 1.2, 0.75

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item: its last sentence is the answer, all before it the question.

    An item of one sentence is a question without an answer.
    """
    parts = [w for w in (words_of(s) for s in _SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for part in parts[:-1] for w in part], parts[-1]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for place, text in enumerate(batch.column(1).to_pylist()):
            question, answer = question_and_answer(text)
            whole = question + answer
            count = max(1, -(-len(whole) // UNIT))
            size = -(-len(whole) // count) if whole else 0
            for k in range(count if whole else 0):
                part = whole[k * size : (k + 1) * size]
                rows.append((place, k, part, max(0, min(len(question) - k * size, len(part)))))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([r[1] for r in rows], pa.int32()),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
                pa.array([r[3] for r in rows], pa.int32()),
            ],
            names=["item_id", "unit", "words", "question"],
        )


def unit_table(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, unit, words, question, shard): units, the words that are question, and their shard."""
    rows = items.select(F.col(key).alias("item_id"), whole_text(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(_units, f"item_id {kind}, unit int, words array<string>, question int")


@dataclass
class Index:
    """One shard: postings by term, with the largest impact of each block of them."""

    items: list
    units: list[int]
    words: list[list[str]]
    question: list[int]
    terms: dict[str, int]
    postings: list[list[int]]  # unit numbers, ascending
    impacts: list[list[float]]
    block_max: list[list[float]]
    list_max: list[float]
    driving: np.ndarray  # terms that alone decide whether a unit can reach the threshold
    span_of: list[np.ndarray]  # of a driving term: the spans of its units,
    span_max: list[np.ndarray]  # and its largest impact in each
    span_rest: np.ndarray  # the most that the other terms add to a unit of a span

    @classmethod
    def build(cls, items: list, units: list[int], words: list[list[str]], question: list[int], idf: dict[str, float], mean: float):
        terms: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        for number, unit in enumerate(words):
            freq: dict[str, int] = {}
            for word in unit:
                freq[word] = freq.get(word, 0) + 1
            scale = K1 * (1 - B + B * len(unit) / mean)
            weights = {w: idf[w] * n * (K1 + 1) / (n + scale) for w, n in freq.items()}
            total = sum(weights.values())
            for word, weight in weights.items():
                at = terms.setdefault(word, len(terms))
                if at == len(lists):
                    lists.append([])
                lists[at].append((number, weight / total))
        postings = [np.array([x[0] for x in entry]) for entry in lists]
        impacts = [np.array([x[1] for x in entry]) for entry in lists]
        block_max = [np.maximum.reduceat(v, np.arange(0, len(v), BLOCK)) for v in impacts]
        # Common terms, commonest first, stay out of the first test while no unit gains more than
        # ``REST`` from them.
        rest, driving = np.zeros(len(words)), np.ones(len(terms), bool)
        for at in sorted(range(len(terms)), key=lambda k: -len(postings[k])):
            if (rest[postings[at]] + impacts[at] > REST).any():
                break
            rest[postings[at]] += impacts[at]
            driving[at] = False
        spans = [p // SPAN for p in postings]
        heads = [np.flatnonzero(np.diff(s, prepend=-1)) for s in spans]
        return cls(
            items, units, words, question, terms, [p.tolist() for p in postings], [v.tolist() for v in impacts],
            [v.tolist() for v in block_max], [float(v.max()) for v in impacts], driving,
            [s[h] for s, h in zip(spans, heads)],
            [np.maximum.reduceat(v, h) for v, h in zip(impacts, heads)],
            np.array([rest[k : k + SPAN].max() for k in range(0, max(len(words), 1), SPAN)] if len(words) else [0.0]),
        )

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all units that score ``threshold`` or more, with their scores."""
        bound = [self.list_max[t] for t in query]
        # Cursors in unit order: (unit, term of the query, place in its list).
        cursors = [(self.postings[t][0], k, 0) for k, t in enumerate(query)]
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for rank, (_, k, _) in enumerate(cursors):
                total += bound[k]
                if total >= threshold - 1e-9:
                    pivot = rank
                    break
            if pivot < 0:
                break
            unit = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == unit:
                pivot += 1
            # The blocks in which the lists would hold the pivot bound its score more tightly.
            limit, leave = 0.0, len(self.words)
            for _, k, place in cursors[: pivot + 1]:
                listed = self.postings[query[k]]
                block = bisect_left(listed, unit, place) // BLOCK
                if block < len(self.block_max[query[k]]):
                    limit += self.block_max[query[k]][block]
                    last = min((block + 1) * BLOCK, len(listed)) - 1
                    leave = min(leave, listed[last] + 1)
            if limit < threshold - 1e-9:
                if pivot + 1 < len(cursors):
                    leave = min(leave, cursors[pivot + 1][0])
                target = max(leave, unit + 1)
            else:
                score = 0.0
                for _, k, place in cursors[: pivot + 1]:
                    listed = self.postings[query[k]]
                    at = bisect_left(listed, unit, place)
                    if at < len(listed) and listed[at] == unit:
                        score += self.impacts[query[k]][at]
                if score >= threshold - 1e-9:
                    found.append((unit, score))
                target = unit + 1
            moved = []
            for _, k, place in cursors[: pivot + 1]:
                listed = self.postings[query[k]]
                at = bisect_left(listed, target, place)
                if at < len(listed):
                    moved.append((listed[at], k, at))
            cursors = moved + cursors[pivot + 1 :]
        return found

    def overlaps(self, unit: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the trigrams of the question and of the answer that the passage holds.

        Where either has too few of them to be judged alone, or none in this unit, both are the share of
        the unit as a whole, whatever the length of its item.
        """
        words, cut = self.words[unit], self.question[unit]
        if min(cut, len(words) - cut) < JUDGED + NGRAM - 1:
            whole = _share(words, passage)
            return whole, whole
        return _share(words[:cut], passage), _share(words[cut:], passage)


def _share(part: list[str], passage: list[str]) -> float:
    if not part:
        return 1.0
    n = min(NGRAM, len(part))
    held = set(zip(*[passage[k:] for k in range(n)]))
    wanted = set(zip(*[part[k:] for k in range(n)]))
    return len(wanted & held) / len(wanted)


def _matches(known, threshold: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = known.value
        find, spans = index.terms.get, len(index.span_rest)
        counts = np.array([len(s) for s in index.span_of])
        flat_spans = np.concatenate([*index.span_of, np.zeros(0, np.int64)])
        flat_max = np.concatenate([*index.span_max, np.zeros(0)])
        begins = np.cumsum(counts) - counts
        for batch in batches:
            rows = []
            for place in range(batch.num_rows):
                words = words_of(batch.column(1)[place].as_py())
                seen = np.array(list(map(find, words, repeat(-1))), np.int64)
                at = np.flatnonzero(seen >= 0)
                at = at[index.driving[seen[at]]]
                if not len(at):
                    continue
                # First test, for all passages of the text: spans of units that can reach the threshold.
                slot, term = at // STRIDE, seen[at]
                passage = np.concatenate((slot, slot - 1))
                pairs = np.unique((passage + 1) * len(index.terms) + np.concatenate((term, term)))
                passage, term = pairs // len(index.terms) - 1, pairs % len(index.terms)
                size = counts[term]
                ends = np.cumsum(size)
                source = np.arange(ends[-1]) + np.repeat(begins[term] - ends + size, size)
                cell = (np.repeat(passage, size) + 1) * spans + flat_spans[source]
                cells, back = np.unique(cell, return_inverse=True)
                sums = np.bincount(back, flat_max[source]) + index.span_rest[cells % spans]
                for k in np.unique(cells[sums >= threshold - 1e-9] // spans - 1):
                    begin = max(0, int(k)) * STRIDE
                    part = words[begin : (int(k) + 2) * STRIDE]
                    query = sorted({int(t) for t in seen[begin : (int(k) + 2) * STRIDE] if t >= 0})
                    for unit, score in index.search(query, threshold):
                        asked, answered = index.overlaps(unit, part)
                        if asked >= QUESTION and answered >= ANSWER:
                            rows.append((place, index.items[unit], int(k), score, asked, answered))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                    batch.column(2).take(pa.array([r[0] for r in rows], pa.int64())),
                    pa.array([r[1] for r in rows], known.value.item_type),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.float64()),
                    pa.array([r[4] for r in rows], pa.float64()),
                    pa.array([r[5] for r in rows], pa.float64()),
                ],
                names=["doc_id", "print", "item_id", "passage", "score", "question_overlap", "answer_overlap"],
            )
        give_back()

    return match


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """One row per document and test item that it holds.

    Columns: doc_id, print (hash of the text), item_id, passages, score, question_overlap,
    answer_overlap (of the best passage; both the share of the whole unit where it has too little of
    either). Every passage of every text is searched. Null and empty texts
    and items match nothing; repeated rows of one key and text give one row; null keys are kept; an
    empty table on either side gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text("text").alias("text"), F.xxhash64(whole_text("text")).alias("print"))
    units = cut_lineage(unit_table(items))
    kinds = (rows.schema["doc_id"].dataType.simpleString(), units.schema["item_id"].dataType.simpleString())
    stats = units.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"), F.sum(F.size("words")).alias("words")).first()
    total = stats["n"]
    shards = max(1, -(-int(stats["words"] or 0) // shard_words))
    # df over all units, whatever the shard.
    df = units.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    shard_of = F.pmod(F.xxhash64("item_id", "unit"), F.lit(shards))
    if shards > 1:
        idf = cut_lineage(idf)
    found = None
    for shard in range(shards):
        part = units.where(shard_of == shard)
        held = part.orderBy("item_id", "unit").toArrow()
        weights = (
            part.select(F.explode("words").alias("term")).distinct().join(idf, "term").select("term", "idf").toArrow()
        )
        index = Index.build(
            held["item_id"].to_pylist(),
            held["unit"].to_pylist(),
            held["words"].to_pylist(),
            held["question"].to_pylist(),
            dict(zip(weights["term"].to_pylist(), weights["idf"].to_pylist())),
            float(stats["mean"] or 1.0),
        )
        index.item_type = held.schema.field("item_id").type
        hits = rows.mapInArrow(
            _matches(spark.sparkContext.broadcast(index), threshold),
            f"doc_id {kinds[0]}, print long, item_id {kinds[1]}, passage int, score double,"
            " question_overlap double, answer_overlap double",
        )
        found = hits if found is None else found.unionByName(hits)
    best = F.max_by(F.struct("score", "question_overlap", "answer_overlap"), F.struct("score", "question_overlap", "answer_overlap"))
    return (
        found.groupBy("doc_id", "print", "item_id")
        .agg(F.countDistinct("passage").alias("passages"), best.alias("best"))
        .select("doc_id", "print", "item_id", "passages", "best.*")
    )

"""Language ID by mixture inference.

A model holds the log-likelihood of hashed letter trigrams in each learned language. A document is a
mixture: expectation-maximisation over its words estimates the share of each language, and the set of
languages is the one of highest likelihood less a penalty for each language in it.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import give_back

TRAIN_ROWS = 3_000  # labelled documents per language that the model is fitted on, whole texts
CELLS = 1 << 16  # hashed trigrams
SMOOTHING = 0.5
ROUNDS = 8  # of expectation-maximisation over all languages
SET_ROUNDS = 4  # more for each smaller set of languages
PENALTY = 2.0  # log-likelihood per further language, times the log of the words
FLOOR = -30.0  # log-likelihood that a word loses at most against its best language
CHARS_AT_ONCE = 2_000_000
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


@functools.cache
def _true_letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram cell of each letter, first letter of each word, document of each word, letters seen)."""
    lowered = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered])
    codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    plain = np.where(letter, codes, 32).astype(np.uint32)
    before = np.concatenate((np.array([32], np.uint32), plain[:-1]))
    after = np.concatenate((plain[1:], np.array([32], np.uint32)))
    at = np.flatnonzero(letter)
    mixed = before[at] * np.uint32(0x9E3779B1) ^ plain[at] * np.uint32(0x85EBCA6B) ^ after[at] * np.uint32(0xC2B2AE35)
    cells = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    heads = np.flatnonzero(before[at] == 32)
    ends = np.cumsum(sizes)
    document = np.searchsorted(ends, at[heads], side="right")
    true = np.zeros(len(texts), bool)
    true[np.unique(np.searchsorted(ends, np.flatnonzero(_true_letters()[codes]), side="right"))] = True
    return cells, heads, document, true


@dataclass
class Model:
    """Learned languages in order, and log-likelihoods by cell and language (at most CELLS x languages)."""

    languages: list[str]
    table: np.ndarray

    def infer(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[str]]]:
        """Predicted language, its share, and the selected set, of each text."""
        n, kinds = len(texts), len(self.languages)
        names, shares, sets = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
        if not kinds or not n:
            return names, shares, sets
        cells, heads, document, true = _words(texts)
        if not len(heads):
            return names, shares, sets
        each = np.add.reduceat(self.table[cells], heads, axis=0)  # words x languages
        top = each.max(axis=1)
        like = np.exp(np.maximum(each - top[:, None], FLOOR))
        weight = np.bincount(document, minlength=n).astype(np.float64)
        base = np.bincount(document, top, minlength=n)
        cuts = np.flatnonzero(np.concatenate(([True], document[1:] != document[:-1])))
        rows = document[cuts]

        def rounds(mix: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(times):
                joint = like * mix[document]
                joint /= joint.sum(axis=1, keepdims=True)
                mix = mix.copy()
                mix[rows] = np.add.reduceat(joint, cuts, axis=0) / weight[rows, None]
            whole = np.log((like * mix[document]).sum(axis=1))
            return mix, base + np.bincount(document, whole, minlength=n)

        full, fit = rounds(np.full((n, kinds), 1.0 / kinds, np.float32), ROUNDS)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        price = PENALTY * np.log(np.maximum(weight, 2))
        best, best_fit = full, fit - price * kinds
        for size in range(kinds - 1, 0, -1):  # the sets of the largest shares
            some = np.where(rank < size, np.maximum(full, 1e-6), 0).astype(np.float32)
            some /= some.sum(axis=1, keepdims=True)
            some, fit = rounds(some, SET_ROUNDS if size > 1 else 0)
            better = fit - price * size >= best_fit
            best = np.where(better[:, None], some, best)
            best_fit = np.where(better, fit - price * size, best_fit)
        for k in rows:
            if true[k]:
                winner = int(np.argmax(best[k]))
                names[k], shares[k] = self.languages[winner], min(1.0, float(best[k, winner]))
                sets[k] = [self.languages[j] for j in np.argsort(-best[k], kind="stable") if best[k, j] > 0.01]
        return names, shares, sets


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = batch.column(0).to_pylist()
        for language in set(languages):
            texts = [t for t, x in zip(batch.column(1).to_pylist(), languages) if x == language]
            held = sums.setdefault(language, np.zeros(CELLS, np.int64))
            for start in range(0, len(texts), 256):
                cells = _words(texts[start : start + 256])[0]
                held += np.bincount(cells, minlength=CELLS)
    for language, held in sums.items():
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict(
            {
                "lang": pa.array([language] * len(some), pa.string()),
                "cell": pa.array(some, pa.int32()),
                "n": pa.array(held[some], pa.int64()),
            }
        )


def is_held_out(key: Column) -> Column:
    """Whether a row is kept from training: crc32 of its key as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from at most about ``rows`` labelled documents of each language, none held out.

    The documents are those of smallest key hash, so every language is drawn from the whole table.
    Rows without text or language teach nothing; with none left the model knows no language.
    """
    usable = docs.where(~is_held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not sizes:
        return Model([], np.zeros((CELLS, 0), np.float32))
    room = 1 << 30
    spot = F.pmod(F.xxhash64(F.col(key), F.lit("train")), F.lit(room))
    limit = F.create_map([F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, rows / n) * room))])
    drawn = usable.where(spot < limit[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = drawn.mapInArrow(_counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    held = sums.toArrow()  # at most CELLS rows per language
    languages = sorted(set(held["lang"].to_pylist()))
    place = {name: k for k, name in enumerate(languages)}
    counts = np.full((CELLS, len(languages)), SMOOTHING)
    counts[held["cell"].to_numpy(), [place[x] for x in held["lang"].to_pylist()]] += held["n"].to_numpy()
    del held
    give_back()
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and lang_set (after ``prefix``) behind its columns, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0 and an empty set. Columns of those
    names are replaced. Equal shares go to the language that sorts first. Rows are neither dropped
    nor reordered; an empty table gives an empty result.
    """
    ours = [prefix + name for name in ("lang_pred", "score", "lang_set")]
    kept = docs.drop(*[c for c in docs.columns if c in ours])
    known = docs.sparkSession.sparkContext.broadcast(model)
    place = kept.columns.index(text)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            names, shares, sets = [], [], []
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= CHARS_AT_ONCE):
                    chars += len(texts[stop])
                    stop += 1
                part = known.value.infer(texts[start:stop])
                names += part[0]
                shares += part[1].tolist()
                sets += part[2]
                start = stop
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(names, pa.string()),
                    pa.array(shares, pa.float64()),
                    pa.array(sets, pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, *ours],
            )
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(infer, f"{schema}, `{ours[0]}` string, `{ours[1]}` double, `{ours[2]}` array<string>")


def language_of(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, lang_set."""
    model = fit(docs, rows)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set")

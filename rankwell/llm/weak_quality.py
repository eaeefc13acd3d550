"""Quality by weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the
counts of all vote patterns estimates how accurate each labeller is and how common good text is, which
gives every pattern a posterior. The posteriors of a bounded sample train a linear scorer over hashed
words, word pairs and word shapes of the whole text, and the scorer judges every document. The scorer
does not see what the labellers measure, so it finds bad text by its words where no labeller votes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import whole_text

TRAIN_ROWS = 8_000  # documents that the scorer is trained on, whole texts
CELLS = 1 << 18  # hashed words; as many again for pairs
SHAPES = 1 << 10
REMEMBERED = 200_000  # words a Python worker keeps the cells of
ROUNDS = 200
EPOCHS = 12
RATE = 0.2
THRESHOLD = 0.5

_SIGNS = "#$%&*|{}<>\\^~=_"
_ENDS = ".,;:!?\"'()"
_VOWEL = re.compile("[aeiouyàâäáãåæèéêëíìîïóòôöõøúùûüýœ]", re.IGNORECASE)


def measures(text: str) -> dict[str, float]:
    """What the labellers look at."""
    words = text.split()
    n = max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(len(text), 1)
    distinct = set(words)
    return {
        "words": len(words),
        "signs": sum(map(text.count, _SIGNS)) / n,
        "upper": sum(map(str.isupper, words)) / n,
        "shouts": text.count("!") / n,
        "repeats": 1 - len(set(lines)) / max(len(lines), 1),
        "variety": len(distinct) / n,
        "mean": sum(map(len, words)) / n,
        "letters": sum(w.strip(_ENDS).isalpha() for w in words) / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "digits": sum(map(text.count, "0123456789")) / chars,
        "ends": sum(x.rstrip()[-1:] in ".!?…»\"'”" for x in lines) / max(len(lines), 1),
        "vowels": sum(map(bool, map(_VOWEL.search, distinct))) / max(len(distinct), 1),
    }


# The labellers. Each is a measure, the bound from which it votes good (none: it never
# does), and the bound from which it votes bad; between them it does not vote. ``-`` marks measures of
# which less is good.
LABELLERS = (
    ("signs", "-", 0.02, 0.30),
    ("letters", "+", 0.75, 0.50),
    ("upper", "-", None, 0.35),
    ("shouts", "-", None, 0.30),
    ("repeats", "-", None, 0.50),
    ("ends", "+", None, 0.25),
    ("mean", "-", None, 16.0),
    ("variety", "+", None, 0.08),
    ("stutter", "-", None, 0.30),
)


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """Of each labeller 0 for none, 1 for bad, 2 for good; a text without words gets bad from all."""
    if not m["words"]:
        return (1,) * len(LABELLERS)
    out = []
    for name, sense, good, bad in LABELLERS:
        sign = -1 if sense == "-" else 1
        if sign * m[name] <= sign * bad:
            out.append(1)
        else:
            out.append(2 if good is not None and sign * m[name] >= sign * good else 0)
    return tuple(out)


def pattern_of(given: tuple[int, ...]) -> int:
    return sum(v * 3**k for k, v in enumerate(given))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, int] = {}
    for batch in batches:
        for text in batch.column(0):
            key = pattern_of(votes(measures(text.as_py())))
            held[key] = held.get(key, 0) + 1
    yield pa.RecordBatch.from_pydict(
        {"pattern": pa.array(list(held), pa.int32()), "n": pa.array(list(held.values()), pa.int64())}
    )


@dataclass
class LabelModel:
    """``rates[y, k, v]``: how often labeller k votes v on bad (0) and good (1) text."""

    prior: float
    rates: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """From vote patterns and how many documents have each; starts from the labellers' own sense."""
        kinds = len(LABELLERS)
        given = (patterns[:, None] // 3 ** np.arange(kinds)) % 3
        # Expected at the start, and worth a hundredth of the documents after: bad votes are seldom
        # wrong, good votes and silence say less.
        expected = np.tile(np.array([[0.4, 0.4, 0.2], [0.49, 0.01, 0.5]])[:, None, :], (1, kinds, 1))
        hold = max(1.0, 0.01 * counts.sum())
        model = cls(0.8, expected)
        one_hot = np.eye(3)[given]  # patterns x labellers x votes
        for _ in range(ROUNDS):
            good = model.posterior(patterns)
            weight = np.stack([(1 - good) * counts, good * counts])
            sums = np.einsum("yp,pkv->ykv", weight, one_hot) + hold * expected
            rates = sums / sums.sum(axis=2, keepdims=True)
            prior = float(np.clip((weight[1].sum() + 1) / (weight.sum() + 2), 0.01, 0.99))
            still = np.abs(rates - model.rates).max() < 1e-7
            model = cls(prior, rates)
            if still:
                break
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability that a text of each pattern is good."""
        kinds = len(LABELLERS)
        given = (patterns[:, None] // 3 ** np.arange(kinds)) % 3
        logs = np.log(np.maximum(self.rates, 1e-9))
        fit = logs[:, np.arange(kinds)[None, :], given].sum(axis=2)  # y x patterns
        gap = fit[1] - fit[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -50, 50)))


class Cells(dict):
    """word -> its cell, and the cell of its shape above it; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        shape = "A" if word.isupper() else "a" if word.isalpha() else "9" if word.isdigit() else "x" + word[-1]
        cell = xxhash.xxh32_intdigest(word.lower().strip(_ENDS)) % CELLS
        cell += CELLS * (xxhash.xxh32_intdigest(shape) % SHAPES)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = cell
        return cell


def cells_of(text: str, known: Cells) -> np.ndarray:
    """The cells of all words, pairs and shapes of a text, repeats included; each counts 1 / words."""
    both = np.fromiter(map(known.__getitem__, text.split()), np.int64)
    words, shapes = both % CELLS, both // CELLS
    pairs = (words[:-1] * 0x9E3779B1 + words[1:]) % 0x7FFFFFFF % CELLS
    return np.concatenate([words, CELLS + pairs, 2 * CELLS + shapes])


BIAS = 2 * CELLS + SHAPES


def _train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Logistic regression of the posteriors on (cells, shares), by AdaGrad."""
    weights, seen = np.zeros(BIAS + 1), np.full(BIAS + 1, 1e-6)
    order = np.random.default_rng(1)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            cells, values, label = rows[k]
            score = 1 / (1 + np.exp(-np.clip((weights[cells] * values).sum(), -30, 30)))
            step = (score - label) * values
            seen[cells] += step * step
            weights[cells] -= RATE * step / np.sqrt(seen[cells])
    return weights


def _examples(drawn: DataFrame, model: LabelModel) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Cells, shares and posterior of the sample, in the order of its hash, whatever the partitions."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cells()
        for batch in batches:
            cells, shares, given = [], [], []
            for text in batch.column(1).to_pylist():
                m = measures(text)
                given.append(pattern_of(votes(m)))
                some, counts = np.unique(cells_of(text, known), return_counts=True)
                cells.append(np.append(some, BIAS).astype(np.int32))
                shares.append(np.append(counts / max(m["words"], 1), 1.0))
            labels = model.posterior(np.array(given, np.int64)) if given else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cells, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64())), pa.array(labels)],
                names=["h", "cells", "shares", "label"],
            )

    held = drawn.mapInArrow(read, "h long, cells array<int>, shares array<double>, label double").orderBy("h", "label").toArrow()
    return [
        (c.values.to_numpy(), v.values.to_numpy(), y.as_py()) for c, v, y in zip(held["cells"], held["shares"], held["label"])
    ]


def quality(docs: DataFrame, rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, posterior (of the votes), score (of the scorer), kept.

    ``kept`` means that the posterior and the scorer's probability of good text both reach ``threshold``.
    The scorer is trained on about ``rows`` documents, at most twice as many, spread by a hash of key and
    text. Null counts as empty; a text without words gets score 0. Repeated rows each give a row, a null
    key is kept, an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    whole = docs.select("doc_id", whole_text().alias("text"))
    counted = whole.select("text").mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    held = counted.toArrow()  # at most 3 ** labellers rows
    patterns, counts = held["pattern"].to_numpy(), held["n"].to_numpy()
    model = LabelModel.fit(patterns, counts)
    total = int(counts.sum()) if len(counts) else 0
    spot = F.pmod(F.xxhash64("doc_id", "text", F.lit("quality")), F.lit(1 << 30))
    drawn = whole.where(spot < int(min(1.0, rows / max(total, 1)) * (1 << 30)))
    drawn = drawn.select(F.xxhash64("text", "doc_id").alias("h"), "text").distinct().orderBy("h").limit(2 * rows)
    weights = spark.sparkContext.broadcast((model, _train(_examples(drawn, model))))
    kind = whole.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, linear = weights.value
        cells = Cells()
        for batch in batches:
            scores, given = [], []
            for text in batch.column(1):
                text = text.as_py()
                m = measures(text)
                given.append(pattern_of(votes(m)))
                z = float(linear[cells_of(text, cells)].sum()) / max(m["words"], 1) + linear[BIAS]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if m["words"] else 0.0)
            posteriors = known.posterior(np.array(given, np.int64)) if given else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(posteriors, pa.float64()), pa.array(np.array(scores), pa.float64())],
                names=["doc_id", "posterior", "score"],
            )

    scored = whole.mapInArrow(score, f"doc_id {kind}, posterior double, score double")
    return scored.withColumn("kept", (F.col("score") >= threshold) & (F.col("posterior") >= threshold))


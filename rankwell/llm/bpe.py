"""Byte-level BPE of whole texts with Spark's higher-order functions, and decoding.

A fold over the pieces of a word merges, at each step, the pair of lowest rank; ranks come from a
table that is one value of the expression. It runs over distinct words only: once over the commonest words
of the corpus, whose ids every task then holds as a bounded table, and once per group of documents
over the distinct words that are left. Documents never leave the task that reads them.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import common_rows, cut_lineage, fresh_dir, give_back, shuffle_parts, whole_text
from rankwell.llm.pieces import chunk_texts, gather, piece_counts, slices, split_chunks, strings

COMMON = 1_500_000  # words whose ids go to every task
COMMON_BYTES = 32  # longer words are encoded with their documents; bounds the table at 48 MB of words
FOLD_BYTES = 128  # the fold is quadratic in the word, so longer words take the heap below
GROUP_BYTES = 8_000_000  # of documents whose words are encoded together
SLOTS = 1 << 15  # cells of the literal rank table
NO_RANK = (1 << 31) - 1


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The ranks as one value of a plan: cells of small maps from a piece in hex to its rank.

    A scalar subquery, to be selected beside the words right before the fold: Spark merges both projections
    and puts its result into the expression when it runs. As a literal from the start it would be spelled
    out, megabytes long, in every text of the plan that the driver keeps.
    """
    cells: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        cells[zlib.crc32(name.encode()) % SLOTS][name] = rank
    stored = spark.createDataFrame([(json.dumps(cells),)], "cells string")
    return stored.select(F.from_json("cells", "array<map<string,int>>")).scalar()


def fold_merges(words: Column, ranks: Column) -> Column:
    """Ids of each of an array of words as array<array<int>>; the empty word has none."""

    def fold(table: Column) -> Column:
        return F.transform(words, lambda w: F.when(w != "", _fold_word(w, table)).otherwise(F.array().cast("array<int>")))

    return _let(ranks, fold)


def _fold_word(word: Column, table: Column) -> Column:
    """Ids of one word (string) as array<int>: ranked merges over its bytes."""

    def rank(piece: Column) -> Column:
        return F.element_at(F.get(table, (F.crc32(piece) % SLOTS).cast("int")), piece)

    def rank_or_none(piece: Column) -> Column:
        return F.coalesce(rank(piece), F.lit(NO_RANK))

    nothing = F.array().cast("array<int>")

    def start(pieces: Column) -> Column:
        # State: the pieces, and for each pair of neighbours the rank of its union.
        pair = F.transform(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x, i: rank_or_none(F.concat(x, F.get(pieces, i + 1)))
        )
        return F.struct(pieces.alias("pieces"), pair.alias("ranks"))

    def merge_at(state: Column, k: Column) -> Column:
        pieces, ranks = state["pieces"], state["ranks"]

        def merged(union: Column) -> Column:
            left = F.when(k > 1, F.array(rank_or_none(F.concat(F.get(pieces, k - 2), union)))).otherwise(nothing)
            right = F.when(
                k + 1 < F.size(pieces), F.array(rank_or_none(F.concat(union, F.get(pieces, k + 1))))
            ).otherwise(nothing)
            return F.struct(
                F.flatten(
                    F.array(F.slice(pieces, F.lit(1), k - 1), F.array(union), F.slice(pieces, k + 2, F.size(pieces)))
                ).alias("pieces"),
                F.flatten(
                    F.array(
                        F.slice(ranks, F.lit(1), F.greatest(k - 2, F.lit(0))),
                        left,
                        right,
                        F.slice(ranks, k + 2, F.size(pieces)),
                    )
                ).alias("ranks"),
            )

        return _let(F.concat(F.get(pieces, k - 1), F.get(pieces, k)), merged)

    def step(state: Column, _: Column) -> Column:
        return _let(
            F.coalesce(F.array_min(state["ranks"]), F.lit(NO_RANK)),
            lambda least: F.when(
                least < NO_RANK,
                _let(F.array_position(state["ranks"], least).cast("int"), lambda k: merge_at(state, k)),
            ).otherwise(state),
        )

    length = F.octet_length(word)
    in_hex = F.hex(F.encode(word, "UTF-8"))
    pieces = _let(
        in_hex, lambda h: F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(h, 2 * i - 1, F.lit(2)))
    )
    steps = F.sequence(F.lit(2), F.greatest(length, F.lit(2)))
    return F.aggregate(steps, _let(pieces, start), step, lambda s: F.transform(s["pieces"], rank))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word by a heap of pairs, in n log n."""
    import heapq

    n = len(word)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : stop[j]])) is not None:
            heapq.heappush(heap, (rank, i, stop[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if j >= n or stop[i] == 0 or stop[j] != end:
            continue  # one side has been merged meanwhile
        stop[i], stop[j] = end, 0
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = after[i]
    return out


def _stored(path: str, columns: list[str]) -> pa.Table:
    """Columns of a table in the shared folder, which may be on any file system that pyarrow opens."""
    files, base = pa_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (None, path)
    return pq.read_table(base, columns=columns, filesystem=files, use_threads=False, partitioning=None)


@functools.lru_cache(maxsize=1)
def _known_words(path: str) -> tuple[np.ndarray, pa.Array]:
    """Hashes in rising order, and their words; the files are ranges of the hash, in the order of their names."""
    held = _stored(path, ["hash", "piece"])
    return held["hash"].to_numpy(), held["piece"].combine_chunks()


@functools.lru_cache(maxsize=1)
def _known_ids(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of the same words: all of them in one array, and the start and number of each word's."""
    lists = _stored(path, ["ids"])["ids"]
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int32)
    starts = (np.cumsum(sizes) - sizes).astype(np.int32)
    return np.concatenate([np.zeros(0, "<u4"), *(c.flatten().to_numpy().astype("<u4") for c in lists.chunks)]), starts, sizes


def _numbered(known: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups of documents as rows: the word numbers of each, and the distinct words without ids.

    Numbers below the size of the common table are its rows; the others are places in ``words``.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = _known_words(known)
        base = len(table)
        keys, seqs, words, held = [], [], {}, 0

        def group() -> pa.RecordBatch:
            listed = list(words)
            return pa.RecordBatch.from_pydict(
                {
                    "doc_ids": pa.ListArray.from_arrays([0, len(seqs)], pa.concat_arrays(keys)),
                    "seqs": pa.array([seqs], pa.list_(pa.binary())),
                    "words": pa.array([[w if len(w.encode()) <= FOLD_BYTES else "" for w in listed]], pa.list_(pa.string())),
                    "long": pa.array([[w for w in listed if len(w.encode()) > FOLD_BYTES]], pa.list_(pa.string())),
                }
            )

        for batch in batches:
            for part in slices(batch, "text", GROUP_BYTES):
                chunks, places, firsts = chunk_texts(part.column("text"))
                flat, sizes = split_chunks(chunks)
                numbers = _rows_of(flat, hashes, table)
                left = np.flatnonzero(numbers < 0)
                numbers[left] = [base + words.setdefault(w, len(words)) for w in strings(flat.take(pa.array(left)))]
                sizes, starts = sizes[places], (np.cumsum(sizes) - sizes)[places]
                seq = gather(numbers, starts, sizes)
                ends = np.cumsum(np.add.reduceat(sizes, firsts)).tolist()
                keys.append(part.column(0))
                seqs += [seq[a:b].tobytes() for a, b in zip([0, *ends], ends)]
                held += part.column("text").nbytes
                if held >= GROUP_BYTES:
                    yield group()
                    keys, seqs, words, held = [], [], {}, 0
        if seqs:
            yield group()
        keys, seqs, words = [], [], {}
        give_back()

    return number


def _rows_of(words: pa.StringArray, hashes: np.ndarray, table: pa.Array) -> np.ndarray:
    """The row of each word in ``table``, which is sorted by hash; -1 where there is none."""
    if not len(table) or not len(words):
        return np.full(len(words), -1, "<i4")
    # Of equal words one is looked up, in the order of the hashes, so neighbours touch the same memory.
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    wanted = np.array([xxhash.xxh64_intdigest(w, 42) for w in strings(distinct)], np.uint64).view(np.int64)
    order = np.argsort(wanted)
    rows = np.empty(len(wanted), np.int64)
    rows[order] = np.minimum(np.searchsorted(hashes, wanted[order]), len(hashes) - 1)
    near = np.flatnonzero(hashes[rows] == wanted)
    same = pc.equal(table.take(pa.array(rows[near])), distinct.take(pa.array(near)))
    near = near[same.to_numpy(zero_copy_only=False)]
    found = np.full(len(wanted), -1, "<i4")
    found[near] = rows[near]
    return found[coded.indices.to_numpy()]


class _Joined:
    """A fixed array with room behind it for what each group adds."""

    def __init__(self, fixed: np.ndarray):
        self.size, self.held = len(fixed), fixed.copy()

    def with_end(self, more: np.ndarray) -> np.ndarray:
        if self.size + len(more) > len(self.held):
            self.held = np.concatenate([self.held[: self.size], more])
        self.held[self.size : self.size + len(more)] = more
        return self.held


def _finished(known: str, ranks_path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids of every document from its word numbers, and the bytes that the ids stand for."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common_values, common_starts, common_sizes), ranks = _known_ids(known), load_ranks(ranks_path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        sizes_of = np.array([len(p) for p in pieces])
        starts_of, bytes_of = np.cumsum(sizes_of) - sizes_of, np.frombuffer(b"".join(pieces), np.uint8)
        all_values, all_starts, all_sizes = _Joined(common_values), _Joined(common_starts), _Joined(common_sizes)
        for batch in batches:
            for k in range(batch.num_rows):
                folded = batch.column("ids")[k].values
                own_values, own_sizes = folded.values.to_numpy().astype("<u4"), np.diff(folded.offsets.to_numpy())
                own_starts = folded.offsets.to_numpy()[:-1]
                if longs := batch.column("long")[k].as_py():
                    extra = [np.array(heap_merges(w.encode(), ranks), "<u4") for w in longs]
                    at = np.flatnonzero(own_sizes == 0)
                    own_sizes, own_starts = own_sizes.copy(), own_starts.copy()
                    own_sizes[at] = [len(x) for x in extra]
                    own_starts[at] = len(own_values) + np.cumsum(own_sizes[at]) - own_sizes[at]
                    own_values = np.concatenate([own_values, *extra])
                starts = all_starts.with_end((own_starts + len(common_values)).astype(np.int32))
                sizes = all_sizes.with_end(own_sizes.astype(np.int32))
                values = all_values.with_end(own_values)
                counts, hashes, back = [], [], []
                for seq in batch.column("seqs")[k].as_py():
                    numbers = np.frombuffer(seq, "<i4")
                    ids = gather(values, starts[numbers].astype(np.int64), sizes[numbers]).astype("<u4")
                    counts.append(len(ids))
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(gather(bytes_of, starts_of[ids], sizes_of[ids])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[k].values,
                        pa.array(counts, pa.int64()),
                        pa.array(hashes, pa.string()),
                        pa.array(back, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        give_back()

    return finish


def encode_decode(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", common: int = COMMON
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null counts as empty: no ids, and the hash of nothing. Special strings are ordinary text. Words
    longer than ``FOLD_BYTES`` bytes go through ``heap_merges``. Repeated rows each give a row, a null
    key is kept, an empty table gives an empty result, other columns are not read.
    """
    spark = docs.sparkSession
    table = rank_table(spark, load_ranks(path))
    counted = cut_lineage(piece_counts(docs, text=text))
    frequent = common_rows(counted.where(F.octet_length("piece") <= COMMON_BYTES), common)
    # In the order of their hashes, and spread before the fold: the rows are few in bytes, so adaptive
    # plans would put them in few tasks.
    spread = frequent.select("piece", F.xxhash64("piece").alias("hash"))
    spread = spread.repartitionByRange(2 * shuffle_parts(spark), "hash").sortWithinPartitions("hash")
    # The table stays in the shared folder: each Python worker that needs it opens it there once.
    known = fresh_dir(spark, "words")
    ids = F.get(fold_merges(F.array("piece"), F.col("ranks")), F.lit(0)).alias("ids")
    spread.select("hash", "piece", table.alias("ranks")).select("hash", "piece", ids).write.option("compression", "zstd").parquet(known)

    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    grouped = rows.mapInArrow(
        _numbered(known), f"doc_ids array<{kind}>, seqs array<binary>, words array<string>, long array<string>"
    )
    # Written, so that a task runs one Python worker at a time and no lost executor repeats the fold.
    folded = grouped.withColumn("ranks", table).select(
        "doc_ids", "seqs", "long", fold_merges(F.col("words"), F.col("ranks")).alias("ids")
    )
    step = fresh_dir(spark, "folded")
    folded.write.option("compression", "zstd").parquet(step)
    return spark.read.schema(folded.schema).parquet(step).mapInArrow(
        _finished(known, path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

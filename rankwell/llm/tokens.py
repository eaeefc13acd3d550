"""Token ids of whole texts as Simple-8b pages in files, in ascending order of the document key.

The texts are range-partitioned by key; each task writes one shard, whose pages hold whole documents
of about ``PAGE`` ids. The files are Parquet with the coded words as one binary per page, because
every store that Spark writes to can then hold them and a repeated task replaces its own shard. Ids
before a shard come from one total per shard.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenizers import Tokenizer, normalizers

from rankwell.llm import simple8b
from rankwell.llm.common import fresh_dir, shuffle_parts, tokenizer, whole_text
from rankwell.llm.pieces import gather, strings

PAGE = 1 << 20  # ids after which a page is closed
CACHE = 1_000_000  # distinct chunks a Python worker remembers
AT_ONCE = 6_000_000  # bytes of text encoded together

# A word of letters whose case folds one to one, and perhaps a run of marks, which is a piece of its own.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
TOGETHER = 64  # words encoded as one text


class ChunkIds:
    """Ids of distinct chunks, learned as they are met; row 0 is the end of a document.

    The tokenizer drops white space and no piece of it reaches across, so a text is the sum of its
    chunks between blanks, and each distinct chunk is encoded by the tokenizers library once. Words
    are encoded many to a text, whose ids are cut behind those that end a word; a chunk of a word and
    marks is put together from both.
    """

    def __init__(self, path: str, end_id: int):
        self.whole = tokenizer(path)
        # Lower-case words are as the normaliser leaves them, so they skip that step.
        self.plain = Tokenizer.from_str(self.whole.to_str())
        self.plain.normalizer = normalizers.Sequence([])
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for name, k in vocabulary.items() if name.endswith("</w>")]] = True
        self.end_id = end_id
        self.reset()

    def reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.values, self.sizes = array("I", [self.end_id]), array("I", [1])

    def _add(self, chunks: list[str], values: np.ndarray, sizes: np.ndarray) -> None:
        self.rows.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(chunks))))
        self.values.frombytes(values.astype(np.uint32).tobytes())
        self.sizes.frombytes(sizes.astype(np.uint32).tobytes())

    def _add_each(self, coder: Tokenizer, chunks: list[str]) -> None:
        for start in range(0, len(chunks), 4096):  # the library's results are large
            part = chunks[start : start + 4096]
            ids = [c.ids for c in coder.encode_batch_fast(part, add_special_tokens=False)]
            self._add(part, np.array(list(chain.from_iterable(ids)), np.uint32), np.array(list(map(len, ids))))

    def _add_words(self, words: list[str]) -> None:
        for start in range(0, len(words), 64 * TOGETHER):
            part = words[start : start + 64 * TOGETHER]
            texts = [" ".join(part[k : k + TOGETHER]) for k in range(0, len(part), TOGETHER)]
            coded = self.plain.encode_batch_fast(texts, add_special_tokens=False)
            values = np.array(list(chain.from_iterable(c.ids for c in coded)), np.uint32)
            stops = np.flatnonzero(self.ends[values]) + 1
            if len(stops) == len(part):
                self._add(part, values, np.diff(stops, prepend=0))
            else:  # a tokenizer that does not mark the ends of words
                self._add_each(self.plain, part)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, end to end, and the size of each."""
        sizes = np.frombuffer(self.sizes, np.uint32).astype(np.int64)
        starts = (np.cumsum(sizes) - sizes)[rows]
        each = sizes[rows]
        return gather(np.frombuffer(self.values, np.uint32), starts, each), each

    def learn(self, chunks: list[str]) -> None:
        """Adds chunks that are not known yet."""
        cuts = [m and (m[1].lower(), m[2]) for m in map(_WORD.fullmatch, chunks)]
        known = self.rows
        self._add_words([w for w in dict.fromkeys(cut[0] for cut in cuts if cut) if w not in known])
        parts = chain((c for c, cut in zip(chunks, cuts) if not cut), (cut[1] for cut in cuts if cut))
        self._add_each(self.whole, [c for c in dict.fromkeys(parts) if c not in known])
        known.update((c, known[cut[0]]) for c, cut in zip(chunks, cuts) if cut and not cut[1])
        marked = [(c, *cut) for c, cut in zip(chunks, cuts) if cut and cut[1]]
        if marked:
            values, sizes = self._gather(np.array([known[part] for _, *both in marked for part in both], np.int64))
            self._add([c for c, *_ in marked], values, sizes[::2] + sizes[1::2])

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and how many each has."""
        if len(self.rows) > CACHE:
            self.reset()
        texts = pc.replace_substring(texts, "\n", " ")
        texts = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
        lists = pc.split_pattern(texts, " ")
        coded = lists.values.dictionary_encode()
        chunks = strings(coded.dictionary)
        rows = np.array(list(map(self.rows.get, chunks, repeat(-1))), np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            left = [chunks[k] for k in new]
            self.learn(left)
            rows[new] = [self.rows[c] for c in left]
        rows = rows[coded.indices.to_numpy()]
        offsets = lists.offsets.to_numpy()
        rows = np.insert(rows, offsets[1:], 0)  # the end of each document
        offsets = offsets + np.arange(len(offsets))
        values, each = self._gather(rows)
        return values, np.add.reduceat(each, offsets[:-1])


_tables: dict[tuple[str, int], ChunkIds] = {}


def _pages(path: str, end_id: int):
    def page(ids: list[np.ndarray], docs: list[pa.Array], sizes: list[np.ndarray], shard, number, first) -> pa.RecordBatch:
        values = np.concatenate(ids).astype(np.uint64)
        words, offsets = simple8b.encode(values)
        n = sum(map(len, sizes))
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "page": pa.array([number], pa.int32()),
                "first": pa.array([first], pa.int64()),
                "n_ids": pa.array([len(values)], pa.int64()),
                "doc_ids": pa.ListArray.from_arrays([0, n], pa.concat_arrays(docs)),
                "sizes": pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                "block_offsets": pa.array([offsets], pa.list_(pa.int64())),
                "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
            }
        )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tables.setdefault((path, end_id), ChunkIds(path, end_id))
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        ids, docs, sizes, held = [], [], [], 0
        for batch in batches:
            lengths = pc.binary_length(batch.column(1)).to_numpy()
            start = 0
            while start < batch.num_rows:
                reach = np.searchsorted(np.cumsum(lengths[start:]), AT_ONCE, side="right")
                part = batch.slice(start, max(1, int(reach)))
                start += part.num_rows
                values, counts = table.encode(part.column(1))
                ids.append(values)
                docs.append(part.column(0))
                sizes.append(counts)
                held += len(values)
                if held >= PAGE:
                    yield page(ids, docs, sizes, shard, number, first)
                    number, first = number + 1, first + held
                    ids, docs, sizes, held = [], [], [], 0
        if sizes:
            yield page(ids, docs, sizes, shard, number, first)

    return write


def write_token_files(
    docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text"
) -> None:
    """Writes every whole text of ``docs`` as ids with ``end_id`` behind each document.

    Null texts count as empty and give the end id alone. Null keys come first; rows of one key stay
    side by side, in no stated order. An empty table gives files without pages.
    """
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"shard int, page int, first long, n_ids long, doc_ids array<{kind}>, sizes array<long>,"
        " block_offsets array<long>, words binary"
    )
    parts = shuffle_parts(docs.sparkSession)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(_pages(path, end_id), schema).write.parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            words = np.frombuffer(batch.column("words")[k].as_py(), "<u8")
            offsets = batch.column("block_offsets")[k].values.to_numpy()
            sizes = batch.column("sizes")[k].values.to_numpy()
            ids = simple8b.decode(words, offsets, int(sizes.sum())).astype("<u4")
            stops = np.cumsum(sizes)
            starts = stops - sizes
            sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, stops)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_ids")[k].values,
                    "start": pa.array(starts + batch.column("before")[k].as_py(), pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    pages = spark.read.parquet(folder)
    totals = pages.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # One row per shard: as many as the writer had tasks, whatever the size of the corpus.
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("base"))
    kind = pages.schema["doc_ids"].dataType.elementType.simpleString()
    return (
        pages.join(F.broadcast(bases), "shard")
        .select("doc_ids", "sizes", "block_offsets", "words", (F.col("base") + F.col("first")).alias("before"))
        .mapInArrow(_read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    )


def token_files(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    folder = fresh_dir(docs.sparkSession, "tokens")
    write_token_files(docs, folder, path, end_id)
    return read_token_files(docs.sparkSession, folder)

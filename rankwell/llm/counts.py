"""Token counts of whole texts without their ids.

Each distinct pre-token of the corpus is counted once by the tokenizers library. The commonest go to
every task as a bounded table, so most of a document is summed where it is read; the frequencies of
the others are joined to their counts by a shuffle on the pre-token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import common_rows, cut_lineage, tokenizer, whole_text
from rankwell.llm.pieces import chunk_texts, piece_counts, slices, split_chunk, split_chunks, split_pieces, strings

COMMON = 400_000  # pre-tokens sent to every task
COMMON_BYTES = 64  # longer ones are always joined: 400,000 x 64 bytes bound the broadcast


def _splitter(special: tuple[str, ...]):
    """Pre-tokens between the special strings of a text, and those strings themselves."""

    def split(text: str) -> list[str]:
        parts = [text]
        for mark in special:
            if mark in text:
                cut: list[str] = []
                for part in parts:
                    for k, between in enumerate(part.split(mark) if part not in special else [part]):
                        cut += [mark, between] if k else [between]
                parts = cut
        if len(parts) == 1:
            return split_chunk(text)
        return [p for part in parts for p in ([part] if part in special else split_pieces(part))]

    return split


def _count_pieces(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = tokenizer(path).encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(e) for e in coded], pa.int64())],
                names=["piece", "n", "tokens"],
            )

    return count


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text", common: int = COMMON
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Special strings inside a text count as the library's default does, one token each. Null texts
    count as empty: 0 bytes, 0 tokens. Repeated rows each give a row; a null key is kept. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    special = tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    split = _splitter(special)
    counted = piece_counts(docs, lambda chunks: split_chunks(chunks, split, special), text).mapInArrow(_count_pieces(path), "piece string, n long, tokens long")
    counted = cut_lineage(counted)
    short = counted.where(F.octet_length("piece") <= COMMON_BYTES)
    held = common_rows(short, common).select("piece", "tokens").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(held["piece"].to_pylist(), held["tokens"].to_pylist())))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = known.value.get
        for batch in batches:
            for part in slices(batch, "text"):
                chunks, places, firsts = chunk_texts(part.column("text"))
                sums, unknown = np.zeros(len(chunks), np.int64), {}
                for k, chunk in enumerate(strings(chunks)):
                    for piece in split(chunk):
                        tokens = find(piece)
                        if tokens is None:
                            unknown.setdefault(k, []).append(piece)
                        else:
                            sums[k] += tokens
                # Frequencies of the pre-tokens left, per document.
                has = np.zeros(len(chunks), bool)
                has[list(unknown)] = True
                left = np.flatnonzero(has[places])
                owners = np.searchsorted(firsts, left, side="right") - 1
                rare = [Counter() for _ in range(part.num_rows)]
                for owner, chunk in zip(owners.tolist(), places[left].tolist()):
                    rare[owner].update(unknown[chunk])
                pairs = pa.StructArray.from_arrays(
                    [
                        pa.array([p for c in rare for p in c], pa.string()),
                        pa.array([n for c in rare for n in c.values()], pa.int64()),
                    ],
                    names=["piece", "times"],
                )
                offsets = np.append(0, np.cumsum([len(c) for c in rare]))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("print"),
                        part.column("n_bytes"),
                        pa.array(np.add.reduceat(sums[places], firsts), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                    ],
                    names=["doc_id", "print", "n_bytes", "tokens", "rare"],
                )

    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    split_rows = cut_lineage(
        rows.select("doc_id", F.xxhash64("text").alias("print"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
        .mapInArrow(
            per_document,
            f"doc_id {kind}, print long, n_bytes long, tokens long, rare array<struct<piece:string,times:long>>",
        )
    )
    row = ["doc_id", "print", "n_bytes"]
    rare = (
        split_rows.select(*row, F.explode("rare").alias("r"))
        .select(*row, "r.piece", "r.times")
        .join(counted.select("piece", F.col("tokens").alias("each")), "piece")
        .select(*row, (F.col("times") * F.col("each")).alias("tokens"), F.lit(0).alias("copies"))
    )
    # Repeated rows have equal sums on both sides, so the sum over copies divides evenly.
    summed = (
        split_rows.select(*row, "tokens", F.lit(1).alias("copies"))
        .unionByName(rare)
        .groupBy(*row)
        .agg(F.sum("tokens").alias("tokens"), F.sum("copies").alias("copies"))
    )
    n_tokens = F.col("tokens").cast("long")
    return (
        summed.withColumn("tokens", (F.col("tokens") / F.col("copies")).cast("long"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
    )

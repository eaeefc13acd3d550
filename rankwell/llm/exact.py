"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each task of the scan is a sender. It sorts the 64-bit fingerprints of its texts, cuts them by
owner, and sends each owner one Golomb-coded list. An owner finds the fingerprints that several
lists hold and answers every list with a bitmap. Only texts whose bit is set (or that repeat within
their sender) are shuffled, and there equality is that of the bytes.

Rows are bounded per task by the scan partition, lists by partition and owner. A fingerprint that a
third of all rows share is sent once per sender. No fingerprints reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import bit_of, cut_lineage, may_hold, shuffle_parts, whole_text


def golomb_encode(values: np.ndarray, shift: int) -> bytes:
    """Gaps of sorted unsigned integers: quotients by 2**shift in unary, then the remainders."""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    places = np.arange(shift, dtype=np.uint64)
    rest = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def golomb_decode(coded: bytes, n: int, shift: int) -> np.ndarray:
    """The sorted integers of ``golomb_encode``."""
    rest_bytes = (n * shift + 7) // 8
    raw = np.frombuffer(coded, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - rest_bytes]))[:n]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = np.unpackbits(raw[len(raw) - rest_bytes :], count=n * shift).reshape(n, shift)
    places = np.uint64(1) << np.arange(shift, dtype=np.uint64)
    low = (rest.astype(np.uint64) * places).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients << np.uint64(shift)) + low, dtype=np.uint64)


def golomb_shift(n: int, spread: float) -> int:
    """The power of two nearest to 0.69 of the mean gap."""
    return int(np.clip(round(np.log2(max(0.69 * spread / max(n, 1), 1.0))), 0, 62))


def _send(owners: int):
    span = -(-(1 << 64) // owners)  # fingerprints per owner

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        prints = rows["fp"].to_numpy().view(np.uint64)
        distinct, slots, repeats = np.unique(prints, return_inverse=True, return_counts=True)
        owner = (distinct // np.uint64(span)).astype(np.int64) if owners > 1 else np.zeros(len(distinct), np.int64)
        starts = np.searchsorted(owner, np.arange(owners))
        ends = np.append(starts[1:], len(distinct))
        n = rows.num_rows
        yield from pa.table(
            {
                "sender": pa.array(np.full(n, sender, np.int32)),
                "owner": pa.array(owner[slots].astype(np.int32)),
                "slot": pa.array((slots - starts[owner[slots]]).astype(np.int32)),
                "within": pa.array(repeats[slots] > 1),
                "doc_id": rows["doc_id"].combine_chunks(),
                "sha": rows["sha"].combine_chunks(),
                "fp": rows["fp"].combine_chunks(),
                "n": pa.nulls(n, pa.int32()),
                "shift": pa.nulls(n, pa.int32()),
                "coded": pa.nulls(n, pa.binary()),
            }
        ).to_batches(max_chunksize=20_000)
        lists = []
        for k in np.flatnonzero(ends > starts):
            part = distinct[starts[k] : ends[k]] - np.uint64(int(k) * span)
            shift = golomb_shift(len(part), float(span))
            lists.append((int(k), len(part), shift, golomb_encode(part, shift)))
        m = len(lists)
        yield from pa.table(
            {
                "sender": pa.array(np.full(m, sender, np.int32)),
                "owner": pa.array([x[0] for x in lists], pa.int32()),
                "slot": pa.nulls(m, pa.int32()),
                "within": pa.nulls(m, pa.bool_()),
                "doc_id": pa.nulls(m, rows.schema.field("doc_id").type),
                "sha": pa.nulls(m, pa.binary()),
                "fp": pa.nulls(m, pa.int64()),
                "n": pa.array([x[1] for x in lists], pa.int32()),
                "shift": pa.array([x[2] for x in lists], pa.int32()),
                "coded": pa.array([x[3] for x in lists], pa.binary()),
            }
        ).to_batches(max_chunksize=1_000)

    return send


def _answer(lists: pa.Table) -> pa.Table:
    """One owner: a bitmap for each list, with a bit for every fingerprint that another list holds."""
    sizes = lists["n"].to_pylist()
    parts = [golomb_decode(c, n, s) for c, n, s in zip(lists["coded"].to_pylist(), sizes, lists["shift"].to_pylist())]
    _, back, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = seen[back] > 1
    cuts = np.cumsum(sizes)[:-1]
    bitmaps = [np.packbits(bits, bitorder="little").tobytes() for bits in np.split(shared, cuts)]
    return pa.table({"sender": lists["sender"], "owner": lists["owner"], "bitmap": pa.array(bitmaps, pa.binary())})


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", owners: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, print (64-bit hash).

    Equal means the same bytes; null counts as empty. Of equal texts the largest key stays. Rows
    repeated under one key count in ``group_size`` and share ``kept``; a null key loses to any other,
    and where all keys of a group are null ``keep_id`` is null and all its rows stay. An empty table
    gives an empty result. Other columns of ``docs`` are not read.
    """
    owners = owners or shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    printed = rows.select(
        "doc_id", F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha")
    )
    sent = cut_lineage(
        printed.mapInArrow(
            _send(owners),
            f"sender int, owner int, slot int, within boolean, doc_id {kind}, sha binary, fp long,"
            " n int, shift int, coded binary",
        )
    )
    lists = sent.where("coded is not null").select("sender", "owner", "n", "shift", "coded")
    answers = lists.groupBy("owner").applyInArrow(_answer, "sender int, owner int, bitmap binary")
    marked = sent.where("coded is null").select("sender", "owner", "slot", "within", "doc_id", "sha", "fp")
    marked = cut_lineage(
        marked.join(answers, ["sender", "owner"], "left").select(
            "doc_id", "sha", "fp", (F.col("within") | bit_of(F.col("bitmap"), F.col("slot"))).alias("suspect")
        )
    )
    suspects = may_hold(rows.withColumn("fp", F.xxhash64("text")), marked.where("suspect"), "fp")
    groups = (
        # What passes the bitmap by chance forms groups that no suspect looks up.
        suspects.groupBy("text")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size")
    )
    alone = marked.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha", "fp"
    )
    grouped = marked.where("suspect").join(groups, "sha").select("doc_id", "keep_id", "group_size", "sha", "fp")
    return alone.unionByName(grouped).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        F.col("fp").alias("print"),
    )

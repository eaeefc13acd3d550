"""Near-duplicate classes of whole texts by SimHash fingerprints and covering bit masks.

A mask keeps the bits whose vector has an odd product with the mask's own vector. Two fingerprints
within the radius differ in at most ``radius`` bits, so some nonzero vector of ``radius`` + 1
dimensions is orthogonal to all those bits' vectors: its mask keeps none of them, and the two agree
under it. Seven masks therefore find every pair within two bits, for certain.

Only distinct fingerprints meet. A bucket that holds many is covered again by seven masks over the
bits that its own mask left out; what agrees there differs in at most twelve bits, so no bucket can
hold more than 4,096 fingerprints. Every bucket sends a spanning star of each of its classes on.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut_lineage, shuffle_parts, whole_text
from rankwell.llm.components import components
from rankwell.llm.pieces import slices
from rankwell.session import broadcast_if_small

RADIUS = 2
SEED = 42
SHINGLE = 3
BUCKET = 2_048  # fingerprints of a bucket compared as they are; larger ones are covered again
FEW = 24  # buckets up to this size are compared together
HOT = 100_000  # rows of one fingerprint that take their class from a broadcast table
HASHED = 1 << 17  # shingles whose bits are counted at a time


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over some bit places, one for each nonzero vector of ``radius`` + 1 dimensions."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << bit for k, bit in enumerate(bits) if (((k % vectors) + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


MASKS = covering_masks(list(range(64)))
DEEPER = [[mask | sub for sub in covering_masks([b for b in range(64) if not mask >> b & 1])] for mask in MASKS]


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every shingle of a text, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space cuts
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        joined, n = iter([b" ".join(words)]), 1
    else:
        joined = map(b" ".join, zip(*(itertools.islice(words, k, None) for k in range(SHINGLE))))
        n = len(words) - SHINGLE + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, itertools.repeat(SEED)), np.uint64, n)


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes: bits set in over half of them; zero of none."""
    out = np.zeros(len(hashes), np.uint64)
    places = np.arange(64, dtype=np.uint64)
    held, first, size = [], 0, 0

    def flush(end: int) -> None:
        nonlocal held, first, size
        if held:
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sizes = np.array([len(h) for h in held])
            some = np.flatnonzero(sizes)
            if len(some):
                starts = (np.cumsum(sizes) - sizes)[some]
                sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
                set_bits = (2 * sums > sizes[some, None]).astype(np.uint64)
                out[first + some] = (set_bits << places).sum(axis=1, dtype=np.uint64)
        held, first, size = [], end, 0

    for k, h in enumerate(hashes):
        if len(h) > HASHED:  # a very long text: its bits are counted in parts
            flush(k)
            sums = np.zeros(64, np.int64)
            for at in range(0, len(h), HASHED):
                part = np.ascontiguousarray(h[at : at + HASHED]).view(np.uint8).reshape(-1, 8)
                sums += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = ((2 * sums > len(h)).astype(np.uint64) << places).sum(dtype=np.uint64)
            first = k + 1
            continue
        held.append(h)
        size += len(h)
        if size >= HASHED:
            flush(k + 1)
    flush(len(hashes))
    return out


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            prints = majority([shingle_hashes(t) for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row, as a signed long."""
    rows = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(_print, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _classes(prints: np.ndarray) -> np.ndarray:
    """For each of some distinct fingerprints the first one it is connected to within the radius."""
    n = len(prints)
    near = np.empty((n, n), bool)
    for at in range(0, n, 256):
        near[at : at + 256] = np.bitwise_count(prints[at : at + 256, None] ^ prints) <= RADIUS
    root = np.full(n, -1)
    for k in range(n):
        if root[k] < 0:
            edge = np.array([k])
            while len(edge):  # every fingerprint is an edge once
                root[edge] = k
                edge = np.flatnonzero(near[edge].any(axis=0) & (root < 0))
    return root


def _stars(starts: np.ndarray, sizes: np.ndarray, prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (a, b) that connect what is connected within each bucket."""
    left, right = [], []
    small = np.flatnonzero((sizes > 1) & (sizes <= FEW))
    for gap in range(1, FEW):  # small buckets side by side: neighbours at each distance
        small = small[sizes[small] > gap]
        if not len(small):
            break
        room = sizes[small] - gap
        at = np.repeat(starts[small] - (np.cumsum(room) - room), room) + np.arange(room.sum())
        a, b = prints[at], prints[at + gap]
        near = np.bitwise_count(a ^ b) <= RADIUS
        left.append(a[near])
        right.append(b[near])
    for k in np.flatnonzero(sizes > FEW):
        bucket = prints[starts[k] : starts[k] + sizes[k]]
        root = _classes(bucket)
        moved = np.flatnonzero(root != np.arange(len(bucket)))
        left.append(bucket[root[moved]])
        right.append(bucket[moved])
    return left, right


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets that arrive one behind the other; at most one bucket is held over a batch."""
    held = [np.zeros(0, np.int64)] * 3

    def links(columns: list[np.ndarray], upto: int) -> Iterator[pa.RecordBatch]:
        table, bucket, prints = (c[:upto] for c in columns)
        if upto < 2:
            return
        new = np.flatnonzero((table[1:] != table[:-1]) | (bucket[1:] != bucket[:-1])) + 1
        starts = np.concatenate([[0], new])
        sizes = np.diff(np.concatenate([starts, [upto]]))
        left, right = _stars(starts, sizes, prints.view(np.uint64))
        if left:
            a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        rows = [batch.column(n).to_numpy().astype(np.int64) for n in ("table", "bucket", "fp")]
        held = [np.concatenate(pair) for pair in zip(held, rows)]
        if not len(held[0]):
            continue
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
        upto = int(np.argmax(last))
        yield from links(held, upto)
        held = [c[upto:] for c in held]
    yield from links(held, len(held[0]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked_prints(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links within the radius that connect all connected ones of distinct ``fp`` rows."""
    parts = shuffle_parts(prints.sparkSession)

    def covered(rows: DataFrame, masks: list) -> DataFrame:
        return rows.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])))

    first = covered(prints, MASKS).toDF("fp", "table", "bucket")
    large = cut_lineage(first.groupBy("table", "bucket").count().where(F.col("count") > bucket).select("table", "bucket"))
    if large.isEmpty():
        dealt = first
    else:
        held = broadcast_if_small(large)
        again = first.join(held, ["table", "bucket"], "left_semi")
        deeper = F.get(F.array(*[F.array(*[F.lit(_signed(m)) for m in row]) for row in DEEPER]), F.col("table"))
        second = again.select(
            "fp", "table", F.posexplode(F.transform(deeper, lambda m: F.col("fp").bitwiseAND(m))).alias("sub", "bucket")
        ).select("fp", (F.col("table") * 8 + F.col("sub") + 8).alias("table"), "bucket")
        dealt = first.join(held, ["table", "bucket"], "left_anti").unionByName(second)
    dealt = dealt.select("table", "bucket", "fp").repartition(parts, "table", "bucket")
    return dealt.sortWithinPartitions("table", "bucket", "fp").mapInArrow(_link, "a long, b long")


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at two or fewer differing bits; a component is all that links reach, and its id
    the smallest key in it. Null counts as empty, and texts without a word have fingerprint zero and
    link like any other. Repeated rows each give a row; a null key counts only where a component has
    no other, and then ``component_id`` is null. An empty table gives an empty result; other columns
    are not read.
    """
    printed = cut_lineage(fingerprints(docs, key, text))
    prints = cut_lineage(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    roots = cut_lineage(components(linked_prints(prints.select("fp"), bucket)))
    linked = prints.join(roots, prints["fp"] == roots["node"]).select("fp", "root", "least", "rows")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(smallest, "root").select("fp", "component_id", "rows")
    copies = prints.where("rows > 1").join(roots, prints["fp"] == roots["node"], "left_anti")
    classes = cut_lineage(classes.unionByName(copies.select("fp", F.col("least").alias("component_id"), "rows")))
    # A fingerprint that very many rows share is found in a broadcast table, the others by a shuffle.
    hot = classes.where(F.col("rows") > HOT).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))
    rest = classes.where(F.col("rows") <= HOT).select("fp", "component_id", F.lit(True).alias("cool"))
    marked = printed.join(broadcast_if_small(hot), "fp", "left")
    cool = marked.where("hot is null").join(broadcast_if_small(rest), "fp", "left")
    name = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    found = cool.select(
        "doc_id", name, F.when(F.col("cool"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return found.unionByName(marked.where("hot").select("doc_id", name, F.col("hot_id").alias("component_id")))

"""Vectors: nearest neighbours, batches to embed, checks of what came back."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.constants import EMBED_BATCH
from rankwell.functions.text import is_blank
from rankwell.functions.vectors import is_usable_vector
from rankwell.operators.ordered import with_row_number
from rankwell.session import broadcast_if_small, cut_lineage

BLOCK = 1_024  # vectors multiplied together
HELD_BLOCKS = 256  # query blocks whose best pairs a task holds at once: 40 MB at ten a query
PAIRS = 65_536  # pairs whose cosine is summed at once: 64 MB at 64 dimensions
MARGIN = 0.01  # percent of cosine: far more than single precision is off in a sum of products of unit vectors
BROADCAST_BLOCKS = 64  # query blocks sent to every task at most: 32 MB at 64 dimensions


def centroids(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each label, element by element."""
    items = vectors.select(label, F.posexplode(vector).alias("pos", "x"))
    means = items.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("_v"))
    return listed.select(label, F.transform("_v", lambda e: e["x"]).alias(vector))


def _flat(vectors: pa.ListArray) -> tuple[np.ndarray, int]:
    """Unit vectors of the width that most rows have, NaN where a row has none of it, and that width."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy().astype(np.int64)
    width = int(np.bincount(size).argmax()) if len(size) else 0
    matrix = np.full((len(size), width), np.nan)
    at = np.flatnonzero(size == width)
    starts = (np.cumsum(size) - size)[at]
    values = pc.fill_null(vectors.flatten(), 0.0).to_numpy().astype(float)
    matrix[at] = values[starts[:, None] + np.arange(width)]
    with np.errstate(all="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1)[:, None], width


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of (id, vector) as one row: the ids, the unit vectors as bytes, and their width."""
    for batch in batches:
        for part in (batch.slice(k, BLOCK) for k in range(0, batch.num_rows, BLOCK)):
            matrix, width = _flat(part.column(1))
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
            columns = [ids, pa.array([matrix.astype("<f8").tobytes()], pa.binary()), pa.array([width], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["ids", "matrix", "width"])


def _blocks(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    kind = rows.schema[ident].dataType.simpleString()
    return rows.select(F.col(ident).alias("id"), vector).mapInArrow(_pack, f"ids array<{kind}>, matrix binary, width int")


def _best(k: int, names: tuple[str, str]):
    """The best ``k`` of each row's vectors for each of its queries, ties by the smaller id."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width = batch.column("width")[r].as_py()
                ids, queries = batch.column("ids")[r].values, batch.column("q_ids")[r].values
                left, right = (
                    np.frombuffer(batch.column(c)[r].as_py(), "<f8").reshape(-1, width) for c in ("q_matrix", "matrix")
                )
                percent = np.clip(left @ right.T * 100, 0, 100)
                order = pc.sort_indices(ids).to_numpy()  # stable sorts below keep ties in the order of the ids
                percent = np.where(np.isfinite(percent), percent, -1.0)[:, order]
                if k < percent.shape[1]:  # all that reach the k-th value, so ties at the edge are whole
                    edge = -np.partition(-percent, k - 1, axis=1)[:, k - 1]
                    i, j = np.nonzero((percent >= edge[:, None]) & (percent >= 0))
                else:
                    i, j = np.nonzero(percent >= 0)
                by = np.lexsort((j, -percent[i, j], i))
                i, j = i[by], j[by]
                first = np.searchsorted(i, i)
                kept = np.arange(len(i)) - first < k
                i, j = i[kept], j[kept]
                yield pa.RecordBatch.from_arrays(
                    [queries.take(pa.array(i)), ids.take(pa.array(order[j])), pa.array(percent[i, j])],
                    names=[*names, "cosine"],
                )

    return best


def _ranked(rows: DataFrame, k: int, query_id: str, vector_id: str) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("cosine"), vector_id)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vector_id: str,
    query_id: str,
    vector: str = "embedding",
) -> DataFrame:
    """The ``k`` vectors with the highest cosine for each query, exact.

    Both sides are packed into blocks where they are read, and each two blocks of one width meet in a
    join on the width and a number of the query block: the few query blocks are broadcast after a count,
    many are joined by a shuffle. A task multiplies two blocks at a time and hands on the best ``k`` per
    query. A vector that is missing, zero or not finite, or of another width than its block, has no cosine.
    """
    one, other = _blocks(vectors, vector_id, vector), cut_lineage(_blocks(queries, query_id, vector))
    spread = other.groupBy("width").agg(F.count("*").alias("n"))  # one row a width
    numbered = with_row_number(other, ["width"], ["ids"], "_n").select(
        F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), "width", F.col("_n").alias("_block")
    )
    wanted = one.join(F.broadcast(spread), "width").withColumn("_block", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    met = wanted.join(broadcast_if_small(numbered, BROADCAST_BLOCKS), ["width", "_block"])
    kinds = [f"{n} {df.schema[n].dataType.simpleString()}" for n, df in ((query_id, queries), (vector_id, vectors))]
    found = met.select("ids", "matrix", "q_ids", "q_matrix", "width").mapInArrow(
        _best(k, (query_id, vector_id)), ", ".join(kinds) + ", cosine double"
    )
    return _ranked(found, k, query_id, vector_id)


def _planes(tables: int, bits: int, width: int) -> np.ndarray:
    """Fixed random hyperplanes: the same for all rows, runs and machines."""
    return np.random.default_rng(width).standard_normal((tables, bits, width))


def _flips(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``radius`` set."""
    return np.array([sum(1 << b for b in some) for r in range(radius + 1) for some in itertools.combinations(range(bits), r)])


def _hashed(tables: int, bits: int):
    """(id, width, first bucket, buckets of all tables, unit vector) of every vector that has a direction."""
    weights = 1 << np.arange(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, BLOCK) for k in range(0, batch.num_rows, BLOCK)):
                matrix, width = _flat(part.column(1))
                good = np.flatnonzero(np.isfinite(matrix).all(axis=1)) if width else np.zeros(0, np.int64)
                if not len(good):
                    continue
                units = matrix[good]
                codes = np.stack([((units @ planes.T) > 0) @ weights for planes in _planes(tables, bits, width)], axis=1)
                columns = [
                    part.column(0).take(pa.array(good)), pa.array(np.full(len(good), width, np.int32)), pa.array(codes[:, 0]),
                    *(pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes.astype("<i4"), units.astype("<f4"))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "width", "bucket", "codes", "unit"])

    return run


def _same_ids(ids: pa.Array) -> np.ndarray:
    """A number of each id, in ascending order of the ids, null first."""
    by = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    coded = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy()
    numbers = np.empty(len(by), np.int64)
    numbers[by] = np.cumsum(np.append(0, np.diff(coded[by]) != 0)[: len(by)])
    return numbers


def _gathered(batches: Iterator[pa.RecordBatch], copies: int | None = None) -> Iterator[pa.RecordBatch]:
    """Hashed rows as blocks of at most ``BLOCK`` rows of one width.

    Of equal vectors of a batch, the ``copies`` smallest ids are kept, once each: no more can be among
    the best of any query. Equal vectors share their buckets, in which rows are sorted by id.
    """
    for batch in batches:
        if copies is not None:
            alike = pc.binary_join_element_wise(batch.column("codes"), batch.column("unit"), b"").dictionary_encode()
            kind, ident = alike.indices.to_numpy(), _same_ids(batch.column("id"))
            by = np.argsort(kind, kind="stable")
            by = by[np.append(True, (np.diff(kind[by]) != 0) | (np.diff(ident[by]) != 0))[: len(by)]]
            place = np.arange(len(by)) - np.searchsorted(kind[by], kind[by])
            batch = batch.take(pa.array(np.sort(by[place < copies])))
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths):
            rows = batch.take(pa.array(np.flatnonzero(widths == width)))
            for part in (rows.slice(k, BLOCK) for k in range(0, rows.num_rows, BLOCK)):
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
                held = [pa.array([b"".join(part.column(c).to_pylist())], pa.binary()) for c in ("codes", "unit")]
                columns = [ids, pa.array([width], pa.int32()), *held]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "width", "codes", "matrix"])


def _best_in_reach(k: int, names: tuple[str, str], tables: int, bits: int, radius: int):
    """The best ``k`` of a partition's vectors for each query, of those that share a bucket in reach with it."""
    flips = _flips(bits, radius)
    near = np.zeros(1 << bits, bool)  # by the bits in which two buckets differ
    near[flips] = True

    def in_reach(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = near[left[:, 0] ^ right[:, 0]]
        for t in range(1, tables):
            rest = np.flatnonzero(~found)
            found[rest] = near[left[rest, t] ^ right[rest, t]]
        return found

    def met(batch: pa.RecordBatch, r: int, reach: np.ndarray, codes: np.ndarray, edges: np.ndarray | None):
        """Rows of queries, of vectors and the exact cosines of pairs that may be among the best."""
        width = batch.column("width")[r].as_py()
        left, right = (
            np.frombuffer(batch.column(c)[r].as_py(), "<f4").reshape(-1, width) for c in ("q_matrix", "matrix")
        )
        asked = np.frombuffer(batch.column("q_codes")[r].as_py(), "<i4").reshape(-1, tables)
        rows = np.flatnonzero(reach[np.arange(tables), asked].any(axis=1))  # others share no bucket with this block
        if not len(rows):
            return rows, rows, np.zeros(0)
        rough = left[rows] @ right.T * 100
        if edges is None or not len(edges):
            low = np.full(len(rows), -np.inf)
        else:
            low = edges[rows]
        i, j = np.nonzero(rough >= low[:, None] - MARGIN)
        at = in_reach(asked[rows[i]], codes[j])
        i, j = i[at], j[at]
        if len(i) > k * len(rows):  # the k-th best of the block, less what single precision may be off
            kept = np.full(rough.shape, -np.inf, np.float32)
            kept[i, j] = rough[i, j]
            most = k * int(np.bincount(_same_ids(batch.column("ids")[r].values)).max())  # an id may come again
            if most < kept.shape[1]:
                edge = -np.partition(-kept, most - 1, axis=1)[:, most - 1]
                at = rough[i, j] >= edge[i] - MARGIN
                i, j = i[at], j[at]
        exact = np.zeros(len(i))
        for at in (slice(n, n + PAIRS) for n in range(0, len(i), PAIRS)):
            exact[at] = np.clip((left[rows[i[at]]].astype(float) * right[j[at]]).sum(axis=1) * 100, 0, 100)
        return rows[i], j, exact

    def merged(queries: pa.Array, one: tuple, i: np.ndarray, ids: pa.Array, cosine: np.ndarray) -> tuple:
        """Held and new pairs of a query block, each id once, cut to ``k`` a query, and the ``k``-th cosine of each."""
        i, ids, cosine = np.concatenate([one[0], i]), pa.concat_arrays([one[1], ids]), np.concatenate([one[2], cosine])
        rank = _same_ids(ids)
        by = np.lexsort((rank, -cosine, i))
        by = by[np.sort(np.unique(i[by] * len(ids) + rank[by], return_index=True)[1])]
        place = np.arange(len(i)) - np.searchsorted(i[by], i[by])
        edges = np.full(len(queries), -np.inf)
        last = by[place == k - 1]
        edges[i[last]] = cosine[last]
        by = by[place < k]
        return i[by], ids.take(pa.array(by)), cosine[by], edges

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        last, codes, reach = None, None, None

        def rows_of(block: tuple) -> pa.RecordBatch:
            queries, (i, ids, cosine, _) = block
            return pa.RecordBatch.from_arrays([queries.take(pa.array(i)), ids, pa.array(cosine)], names=[*names, "cosine"])

        for batch in batches:
            for r in range(batch.num_rows):
                packed = batch.column("codes")[r].as_py()
                if packed != last:
                    last, codes = packed, np.frombuffer(packed, "<i4").reshape(-1, tables)
                    reach = np.zeros((tables, 1 << bits), bool)
                    for t in range(tables):
                        reach[t, (np.unique(codes[:, t])[:, None] ^ flips).ravel()] = True
                key = batch.column("_block")[r].as_py(), batch.column("width")[r].as_py()
                ids, queries = batch.column("ids")[r].values, batch.column("q_ids")[r].values
                before = held[key][1] if key in held else None
                i, j, cosine = met(batch, r, reach, codes, before and before[3])
                if len(i):
                    empty = np.zeros(0, np.int64), ids.slice(0, 0), np.zeros(0)
                    held[key] = queries, merged(queries, before or empty, i, ids.take(pa.array(j)), cosine)
                if len(held) > HELD_BLOCKS:
                    yield from map(rows_of, held.values())
                    held.clear()
        yield from map(rows_of, held.values())

    return best


def nearest_approximate(
    vectors: DataFrame, queries: DataFrame, k: int, vector_id: str, query_id: str, vector: str = "embedding",
    tables: int = 16, bits: int = 10, radius: int = 2,
) -> DataFrame:
    """The ``k`` nearest vectors among those that share a bucket with the query, ranked by exact cosine.

    Buckets are the signs of ``bits`` random hyperplanes, in ``tables`` independent tables; a query looks
    into every bucket within ``radius`` flipped bits. Every vector is indexed. Vectors lie in blocks in the
    order of their first bucket; a query passes over the blocks none of whose buckets it looks into, and
    meets the others in one matrix product, so candidates are never rows and a partition hands on the best
    ``k`` of each query. A hot bucket is many blocks. Recall is measured in the tests; vectors without any
    structure need these many tables for 0.9, and then no block is passed over.
    """
    def hashed(df: DataFrame, ident: str) -> DataFrame:
        schema = f"id {df.schema[ident].dataType.simpleString()}, width int, bucket long, codes binary, unit binary"
        return df.select(F.col(ident).alias("id"), vector).mapInArrow(_hashed(tables, bits), schema)

    def blocks(df: DataFrame, ident: str, copies: int | None = None) -> DataFrame:
        order = ["width", "bucket", "id"]
        rows = hashed(df, ident).repartitionByRange(*order).sortWithinPartitions(*order)
        kind = df.schema[ident].dataType.simpleString()
        return rows.mapInArrow(lambda batches: _gathered(batches, copies), f"ids array<{kind}>, width int, codes binary, matrix binary")

    asked = cut_lineage(blocks(queries, query_id).withColumn("_at", F.monotonically_increasing_id()))
    spread = asked.groupBy("width").agg(F.collect_list("_at").alias("_blocks"))  # one row a width, a number a block
    named = asked.select(F.col("ids").alias("q_ids"), F.col("codes").alias("q_codes"), F.col("matrix").alias("q_matrix"), "width", F.col("_at").alias("_block"))
    wanted = blocks(vectors, vector_id, k).join(F.broadcast(spread), "width").withColumn("_block", F.explode("_blocks"))
    met = wanted.join(broadcast_if_small(named, BROADCAST_BLOCKS), ["width", "_block"])
    kinds = [f"{n} {df.schema[n].dataType.simpleString()}" for n, df in ((query_id, queries), (vector_id, vectors))]
    found = met.select("ids", "codes", "matrix", "q_ids", "q_codes", "q_matrix", "width", "_block").mapInArrow(
        _best_in_reach(k, (query_id, vector_id), tables, bits, radius), ", ".join(kinds) + ", cosine double"
    )
    # Ids that repeat on either side give a pair several times.
    return _ranked(found.groupBy(query_id, vector_id).agg(F.max("cosine").alias("cosine")), k, query_id, vector_id)


def embed_batches(texts: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Non-blank texts in order, cut into batches of at most one hundred per key."""
    work = texts.where(~is_blank(F.col(text)))
    numbered = with_row_number(work, keys, order, "_n")
    place = F.col("_n") - 1
    return (
        numbered.withColumn("batch", F.floor(place / EMBED_BATCH))
        .withColumn("index", place % EMBED_BATCH)
        .drop("_n")
    )


def accepted_vectors(replies: DataFrame, expected: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of the batches that came back whole.

    A batch is void when an index is missing, repeated or out of range, or any vector has the
    wrong width or a value that is not finite. ``expected`` holds keys and ``expected`` count.
    """
    index = F.col("index")
    state = replies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_distinct("index").alias("_indexes"),
        F.min("index").alias("_low"),
        F.max("index").alias("_high"),
        F.min(is_usable_vector(F.col("embedding"), width)).alias("_usable"),
        F.min(F.coalesce(index == F.floor(index), F.lit(False))).alias("_whole"),
    )
    size = F.col("expected")
    good = state.join(expected, keys).where(
        (F.col("_rows") == size)
        & (F.col("_indexes") == size)
        & (F.col("_low") == 0)
        & (F.col("_high") == size - 1)
        & F.col("_usable")
        & F.col("_whole")
    )
    return replies.join(good.select(*keys), keys, "left_semi")



"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles. Equal sets are one node. In every run the sets are split
on sampled shared tokens: at each place of the recursion one or two minhash coordinates are chosen,
and sets that agree on one go on together, until few are left and these are compared by their
sketches. Runs repeat until a pair at the threshold has met with the target probability; sets of large
buckets, which take more splits, get as many runs more as the deepest of these asks for. What has met
forms groups; inside a group every pair is compared exactly, so links are counted whole even where
sketches or single runs missed them.

Groups that are too large for one task are compared block against block. Pairs are counted where they
are found and never become rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import cut_lineage, give_back, may_hold, shuffle_parts, whole_text
from rankwell.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999  # that a pair at the threshold meets in some run
COORDINATES = 64
SMALL = 1500  # sets that are compared by brute force
DEPTH = 12  # splits across tasks, and again inside a task
BUCKET = 50_000  # sets of a bucket that one task splits further
LOOSE = 0.55  # share of equal coordinates from which sets count as met: five deviations below 0.8
BLOCK = 2048  # sets compared in one task

_MIX = np.random.default_rng(20).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_STEPS = np.random.default_rng(21).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Shingle sets of texts: sorted 64-bit hashes of five words in a row, lower case, as split at blanks.

    A text of fewer words is one shingle of all of them; a text without words is the empty set.
    """

    def __init__(self, remember: int = 200_000):
        self.known: dict[str, int] = {}
        self.remember = remember

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.remember:
            known.clear()
        codes = list(map(known.get, words))
        if None in codes:
            for k, code in enumerate(codes):
                if code is None:
                    codes[k] = known.get(words[k]) or known.setdefault(words[k], xxhash.xxh3_64_intdigest(words[k]))
        h = np.array(codes, np.uint64)
        width = min(SHINGLE, len(words))
        mixed = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            mixed = _finish(mixed + h[k : len(h) - width + 1 + k] * _STEPS[k])
        return np.unique(mixed)


def minhashes(tokens: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(tokens), 4096):  # long texts in parts
        part = tokens[start : start + 4096, None] * _MIX
        np.minimum(out, part.min(axis=0), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def _choose(path: int) -> list[int]:
    """One or two coordinates for a place of the recursion: 1.25 = 1 / 0.8 on average."""
    rng = _finish(np.array([path], np.uint64) + np.arange(1, 4, dtype=np.uint64))
    first = int(rng[0]) % COORDINATES
    if int(rng[1]) % 4:
        return [first]
    return [first, (first + 1 + int(rng[2]) % (COORDINATES - 1)) % COORDINATES]


def _child(path: int, coordinate: int, values: np.ndarray) -> np.ndarray:
    base = np.array([path], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(coordinate + 1)
    return _finish(base + (values.astype(np.uint64) << np.uint64(20)))


def survival(share: float, splits: int) -> float:
    """The probability that two sets with this share of equal coordinates are together somewhere after
    so many splits of a run."""
    out = 1.0
    for _ in range(splits):
        out = 0.75 * share * out + 0.25 * (1 - (1 - share * out) ** 2)
    return out


@functools.cache
def runs_for(recall: float, splits: int = 2) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, where its buckets
    take so many splits until they are small.

    All runs use the same coordinates, so the mean is over how many of them a pair has equal.
    """
    shares = range(math.ceil(LOOSE * COORDINATES), COORDINATES + 1)
    weights = [math.comb(COORDINATES, k) * THRESHOLD**k * (1 - THRESHOLD) ** (COORDINATES - k) for k in shares]
    lost = [1 - survival(k / COORDINATES, splits) for k in shares]
    unseen = 1 - sum(weights)  # by the sketches
    if unseen >= 1 - recall:
        raise ValueError("the sketches have too few coordinates for this recall")
    return next(n for n in count(1) if unseen + sum(w * x**n for w, x in zip(weights, lost)) <= 1 - recall)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its node (hash of the set), the number of shingles, and the minhashes."""
    shingle = Shingler()
    for batch in batches:
        nodes, sizes, hashes = [], [], []
        for text in batch.column("text"):
            tokens = shingle(text.as_py())
            sizes.append(len(tokens))
            nodes.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
            hashes.append(minhashes(tokens).tobytes() if len(tokens) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("print"),
                pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int32()),
                pa.array(hashes, pa.binary()),
            ],
            names=["doc_id", "print", "node", "size", "hashes"],
        )
    shingle.known.clear()
    give_back()


def _roots(runs: range):
    """The first split of these runs: (path, node) rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), "<u4").reshape(n, COORDINATES)
            paths, rows = [], []
            for run in runs:
                for coordinate in _choose(run + 1):
                    paths.append(_child(run + 1, coordinate, hashes[:, coordinate]))
                    rows.append(np.arange(n))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(paths).view(np.int64) if n else [], pa.int64()),
                    batch.column("node").take(pa.array(np.concatenate(rows))),
                ],
                names=["path", "node"],
            )

    return split


def _deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One more split of rows of buckets that are too large for a task."""
    for batch in batches:
        hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), "<u4").reshape(batch.num_rows, COORDINATES)
        paths = batch.column("path").to_numpy().view(np.uint64)
        new, rows = [], []
        for path in np.unique(paths):
            at = np.flatnonzero(paths == path)
            for coordinate in _choose(int(path)):
                new.append(_child(int(path), coordinate, hashes[at, coordinate]))
                rows.append(at)
        taken = batch.take(pa.array(np.concatenate(rows) if rows else [], pa.int64()))
        path = pa.array(np.concatenate(new).view(np.int64) if new else [], pa.int64())
        yield pa.RecordBatch.from_arrays([path, *taken.columns[1:]], names=batch.schema.names)


def _met(hashes: np.ndarray) -> np.ndarray:
    """For each of a few sets, the first set it is connected to through sets with like sketches."""
    n = len(hashes)
    near = np.zeros((n, n), np.uint8)
    for k in range(COORDINATES):
        near += hashes[:, k, None] == hashes[None, :, k]
    near = near >= LOOSE * COORDINATES
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _split(
    path: int, rows: np.ndarray, hashes: np.ndarray, roots: np.ndarray, splits: int, limit: int, small: int,
    edges: list[tuple[int, int]], deep: np.ndarray,
) -> None:
    """Edges of what meets below a bucket that came of so many splits; ``deep`` gets the splits that the
    sets of large buckets take. Sets of one root have met before."""
    if (roots[rows] == roots[rows[0]]).all():
        return
    if len(rows) <= small:
        first = _met(hashes[rows])
        edges += [(int(rows[a]), int(rows[k])) for k, a in enumerate(first) if a != k]
    elif splits >= limit:
        # Sets that agree at every split: taken as met, and compared exactly with their group.
        edges += [(int(rows[0]), int(k)) for k in rows[1:]]
    else:
        deep[rows] = np.maximum(deep[rows], splits + 1)
        for coordinate in _choose(path):
            values = hashes[rows, coordinate]
            order = np.argsort(values, kind="stable")
            cuts = np.flatnonzero(np.diff(values[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    child = int(_child(path, coordinate, values[part[:1]])[0])
                    _split(child, rows[part], hashes, roots, splits + 1, limit, small, edges, deep)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        new = np.flatnonzero(np.append(True, values[1:].to_numpy(zero_copy_only=False) != values[:-1].to_numpy(zero_copy_only=False)))
        for start, stop in zip(new, np.append(new[1:], batch.num_rows)):
            part = batch.slice(int(start), int(stop - start))
            if held and held[0].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _buckets(splits: int, small: int):
    """Of buckets that came of so many splits: edges between sets that meet, at most one less than a
    bucket has sets; and sets alone with the splits they take, where these are more."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "path"):
            nodes = group["node"].to_pylist()
            hashes = np.frombuffer(b"".join(group["hashes"].to_pylist()), "<u4").reshape(len(nodes), COORDINATES)
            roots = np.arange(len(nodes))
            if "root" in group.column_names:
                roots = group["root"].combine_chunks().dictionary_encode().indices.to_numpy()
            edges: list[tuple[int, int]] = []
            deep = np.zeros(len(nodes), np.int32)
            path = int(group["path"][0].as_py()) % (1 << 64)
            _split(path, np.arange(len(nodes)), hashes, roots, splits, splits + DEPTH - 1, small, edges, deep)
            edges = sorted(set(edges))
            large = np.flatnonzero(deep)
            if edges or len(large):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*(nodes[a] for a, _ in edges), *(nodes[k] for k in large)], pa.binary()),
                        pa.array([*(nodes[b] for _, b in edges), *([None] * len(large))], pa.binary()),
                        pa.array([*([None] * len(edges)), *deep[large].tolist()], pa.int32()),
                    ],
                    names=["a", "b", "deep"],
                )
        give_back()

    return meet


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right (or on the left)."""
    other = left if right is None else right
    flat = np.concatenate([*left, *([] if right is None else right)])
    distinct, back, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen > 1  # a token of one set alone is in no intersection
    column = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(len(left) + (0 if right is None else len(right))), [len(x) for x in [*left, *(right or [])]])
    use = shared[back]
    rows, columns = rows[use], column[back[use]]
    out = np.zeros((len(left), len(other)), np.float32)
    width = 2048
    order = np.argsort(columns // width, kind="stable")
    rows, columns = rows[order], columns[order]
    cuts = np.searchsorted(columns // width, np.arange(int(shared.sum()) // width + 2))
    for k in range(len(cuts) - 1):
        at = slice(cuts[k], cuts[k + 1])
        if cuts[k] == cuts[k + 1]:
            continue
        dense = np.zeros((len(left) + (0 if right is None else len(right)), width), np.float32)
        dense[rows[at], columns[at] - k * width] = 1
        mine = dense[: len(left)]
        out += mine @ (mine if right is None else dense[len(left) :]).T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    common = _common(left, right)
    a = np.array([len(x) for x in left], np.float64)[:, None]
    b = np.array([len(x) for x in (left if right is None else right)], np.float64)[None, :]
    linked = common >= threshold * (a + b - common) - 1e-6
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _exact(threshold: float):
    """Exact links of blocks of a group: counts per node and edges that connect what is linked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "task"):
            side = np.array(group["side"].to_pylist())
            nodes, copies = group["node"].to_pylist(), np.array(group["copies"].to_pylist(), np.int64)
            sets = [np.frombuffer(x, "<u8") for x in group["tokens"].to_pylist()]
            if (side == 0).all():
                linked, one, two = _linked(sets, None, threshold), np.arange(len(sets)), np.arange(len(sets))
            else:
                one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                linked = _linked([sets[k] for k in one], [sets[k] for k in two], threshold)
            if not linked.any():
                continue
            links, copied, edges = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), []
            links[one] += linked.sum(axis=1)
            copied[one] += linked @ copies[two]
            if two is not one and not (side == 0).all():
                links[two] += linked.sum(axis=0)
                copied[two] += linked.T @ copies[one]
            for k in np.flatnonzero(linked.any(axis=1)):
                edges.append((int(one[k]), int(two[int(np.argmax(linked[k]))])))
            if not (side == 0).all():
                for k in np.flatnonzero(linked.any(axis=0)):
                    edges.append((int(one[int(np.argmax(linked[:, k]))]), int(two[k])))
            edges += _joining(linked, one, two)
            edges = sorted({(a, b) for a, b in edges if a != b})
            at = np.flatnonzero(links)
            rows = [(nodes[k], None, int(links[k]), int(copied[k])) for k in at]
            rows += [(nodes[a], nodes[b], 0, 0) for a, b in edges]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.binary()),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                    ],
                    names=["a", "b", "links", "copied"],
                )

    return compare


def _joining(linked: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect all of a component of the links found here, as a star of it."""
    size = int(max(one.max(), two.max())) + 1
    label = np.arange(size)
    while True:
        mine, other = label[one], label[two]
        low_one = np.minimum(mine, np.where(linked, other[None, :], size).min(axis=1, initial=size))
        low_two = np.minimum(other, np.where(linked, mine[:, None], size).min(axis=0, initial=size))
        new = label.copy()
        np.minimum.at(new, one, low_one)
        np.minimum.at(new, two, low_two)
        new = new[new]
        if (new == label).all():
            return [(int(a), k) for k, a in enumerate(label) if a != k]
        label = new


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingle = Shingler()
    for batch in batches:
        sets = [shingle(t.as_py()).astype("<u8").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("print"), pa.array(sets, pa.binary())],
            names=["doc_id", "print", "tokens"],
        )
    shingle.known.clear()
    give_back()


def _candidates(nodes: DataFrame, runs: range, bucket: int, small: int) -> DataFrame:
    """(a, b, deep): edges between nodes that met in any of the runs, and nodes of large buckets (b is
    null) with the splits that these take. Nodes may have a root, those of one root have met."""
    spark = nodes.sparkSession
    rooted = ["root"] if "root" in nodes.columns else []
    kinds = ", ".join(["path long", "node binary", "hashes binary", *(f"{c} binary" for c in rooted)])

    def unmet(rows: DataFrame) -> DataFrame:
        found = [F.min("root") < F.max("root")] if rooted else [F.lit(True)]
        sizes = rows.groupBy("path").agg(F.count("*").alias("count"), *(x.alias("unmet") for x in found))
        return rows.join(sizes.where("count > 1 and unmet").drop("unmet"), "path")

    rows = nodes.select("node", "hashes").mapInArrow(_roots(runs), "path long, node binary")
    first = cut_lineage(rows)
    sizes = first.groupBy("path").count().where("count > 1")
    shared = first.join(sizes, "path").select("path", "node", "count").join(nodes.select("node", "hashes", *rooted), "node")
    shared = cut_lineage(shared.select("path", "node", "hashes", *rooted, "count"))
    ready = [shared.where(F.col("count") <= bucket).drop("count")]
    large = shared.where(F.col("count") > bucket).drop("count")
    if rooted:
        large = unmet(large).drop("count")
    deep = []
    depth = 1
    while depth < DEPTH and not large.isEmpty():
        deep.append(large.select("node").distinct().withColumn("deep", F.lit(depth + 1)))
        split = cut_lineage(large.mapInArrow(_deeper, kinds))
        sized = unmet(split)
        ready.append(sized.where(F.col("count") <= bucket).drop("count"))
        large = cut_lineage(sized.where(F.col("count") > bucket).drop("count"))
        depth += 1
    edges = None
    parts = shuffle_parts(spark)
    for splits, rows in enumerate(ready, 1):
        met = (
            rows.repartition(parts, "path")
            .sortWithinPartitions("path")
            .mapInArrow(_buckets(splits, small), "a binary, b binary, deep int")
        )
        edges = met if edges is None else edges.unionByName(met)
    none = F.lit(None)
    for rows in deep:
        edges = edges.unionByName(rows.select(F.col("node").alias("a"), none.cast("binary").alias("b"), "deep"))
    if depth == DEPTH:
        # No split has parted these: taken as met, and compared exactly with their group.
        head = large.groupBy("path").agg(F.min("node").alias("a"))
        met = large.join(head, "path").select("a", F.col("node").alias("b"), none.cast("int").alias("deep"))
        edges = edges.unionByName(met)
    return edges


def _met_groups(nodes: DataFrame, recall: float, bucket: int, small: int) -> DataFrame:
    """(node, root): groups of what has met after the runs that the splits of its buckets ask for.

    After the first runs, only nodes of buckets that took more splits go on, and of these only buckets in
    which not all have met. A round makes about as many rows as the first.
    """
    done, runs = 0, runs_for(recall)
    active, groups, deep = nodes.select("node", "hashes"), None, None
    while True:
        met = cut_lineage(_candidates(active, range(done, runs), bucket, small))
        edges = met.where("b is not null").select("a", "b")
        if groups is not None:
            edges = edges.unionByName(groups.select(F.col("root").alias("a"), F.col("node").alias("b")))
        groups = components(edges)
        seen = met.where("b is null").select(F.col("a").alias("node"), "deep")
        seen = seen if deep is None else seen.unionByName(deep)
        deep = cut_lineage(seen.groupBy("node").agg(F.max("deep").alias("deep")))
        done = runs
        enough = next(n for n in count(2) if runs_for(recall, n + 1) > done)
        pending = deep.where(F.col("deep") > enough)
        left = pending.agg(F.count("*").alias("n"), F.max("deep").alias("deep")).first()
        if not left["n"]:
            return groups
        room = runs_for(recall) * nodes.count() // left["n"]
        runs = min(runs_for(recall, left["deep"]), done + room)
        active = (
            nodes.select("node", "hashes")
            .join(pending.select("node"), "node")
            .join(groups, "node", "left")
            .withColumn("root", F.coalesce("root", "node"))
        )
        active = cut_lineage(active)


def similar_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    block: int = BLOCK,
    bucket: int = BUCKET,
    small: int = SMALL,
) -> DataFrame:
    """One row per document: doc_id, print, class_id, class_size, n_links, n_text_links, kept.

    Two texts are linked when the Jaccard similarity of their shingle sets is ``threshold`` or more. A
    class is what links connect; ``class_id`` is its smallest doc_id, and that document is ``kept`` (of
    several texts under that id, the one of smallest hash). ``n_links`` counts the other
    documents that a document is linked to, copies included; ``n_text_links`` the other shingle sets.
    ``print`` is the hash of the text. Null texts count as empty; texts without words are linked to
    nothing and each is its own class. Null keys take part and come last.
    Repeated rows each give a row. An empty table gives an empty result. Other columns are not read.
    """
    if threshold < THRESHOLD:
        raise ValueError(f"the runs and the sketch bound are set for similarities from {THRESHOLD} up")
    spark = docs.sparkSession
    rows = docs.select("doc_id", whole_text("text").alias("text"), F.xxhash64(whole_text("text")).alias("print"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sets = cut_lineage(
        rows.select("doc_id", "print", "text").mapInArrow(
            _sets, f"doc_id {kind}, print long, node binary, size int, hashes binary"
        )
    )
    nodes = cut_lineage(
        sets.where("node is not null")
        .groupBy("node")
        .agg(
            F.min(F.struct(F.isnull("doc_id").alias("no_key"), "doc_id", "print")).alias("first"),
            F.count("*").alias("copies"),
            F.first("hashes").alias("hashes"),
        )
    )
    groups = _met_groups(nodes, recall, bucket, small)
    members = cut_lineage(groups.join(nodes.drop("hashes"), "node"))

    # Shingles again, for one text of each node of a group. A fixed bitmap of their hashes keeps the
    # other texts out of the shuffle; what passes it by chance finds no partner in the join.
    wanted = members.select("root", "node", "copies", "first.doc_id", "first.print")
    texts = may_hold(rows, wanted, "print")
    tokens = texts.select("doc_id", "print", "text").mapInArrow(_tokens, f"doc_id {kind}, print long, tokens binary")
    same = tokens["doc_id"].eqNullSafe(wanted["doc_id"]) & (tokens["print"] == wanted["print"])
    filled = tokens.join(wanted, same).select("root", "node", "copies", "tokens").dropDuplicates(["node"])

    # Groups beyond a block are cut into blocks by hash, and each pair of blocks is one task.
    sizes = members.groupBy("root").count().select("root", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    placed = filled.join(sizes, "root").withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("other", other).select(
        F.xxhash64("root", F.least("at", "other"), F.greatest("at", "other")).alias("task"),
        (F.col("at") > F.col("other")).cast("int").alias("side"),
        "node",
        "copies",
        "tokens",
    )
    parts = shuffle_parts(spark)
    exact = cut_lineage(
        placed.repartition(parts, "task")
        .sortWithinPartitions("task")
        .mapInArrow(_exact(threshold), "a binary, b binary, links long, copied long")
    )
    counts = exact.where("b is null").groupBy(F.col("a").alias("node")).agg(
        F.sum("links").alias("links"), F.sum("copied").alias("copied")
    )
    classes = components(exact.where("b is not null").select("a", "b"))
    per_node = nodes.select("node", "first", "copies").join(classes, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    )
    per_class = per_node.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    per_node = (
        per_node.join(per_class, "root")
        .join(counts, "node", "left")
        .select(
            "node",
            "head",
            F.col("head.doc_id").alias("class_id"),
            "class_size",
            (F.coalesce("copied", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("links", F.lit(0)).alias("n_text_links"),
        )
    )
    none = F.lit(0).cast("long")
    alone = sets.where("node is null").select(
        "doc_id", "print", F.col("doc_id").alias("class_id"), (none + 1).alias("class_size"), none.alias("n_links"),
        none.alias("n_text_links"), F.lit(True).alias("kept"),
    )
    return (
        sets.where("node is not null")
        .select("doc_id", "print", "node")
        .join(per_node, "node")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("print") == F.col("head.print")))
        .drop("node", "head")
        .unionByName(alone)
    )

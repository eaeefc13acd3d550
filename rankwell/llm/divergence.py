"""How the sources of a language differ in their terms, from one pass over the texts.

Single-pass in-memory indexing. A task of the scan builds block postings, (language, source) to the
counts of its terms, until the block is full, and spills it as one run: sorted by term and cut into a
page for every hash shard. Pages are rows, so runs lie in the shuffle and not on one machine's disk.
A shard's runs are merged by a heap, some at a time, until one is left; its terms are then whole and
the rare ones go. Pair values start from what two sources would have with no term in common, which
follows from each one's own counts, and the terms that both use are streamed as corrections.

All arithmetic is on integers: counts times 10^9 are taken as decimals, the rest fits 64 bits.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import cut_lineage, give_back, shuffle_parts, whole_text
from rankwell.llm.pieces import slices
from rankwell.session import broadcast_if_small

BLOCK = 400_000  # postings of a block before it is spilled
LONG = 200  # bytes; longer terms count towards a block by their bytes
MERGED = 2_000_000  # postings that a task merges at once, on average
SHARDS = 1 << 14  # at most; a run is cut into as many pages
CELLS = 1 << 21  # source pairs corrected at once

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_RUN = (
    "shard int, run long, keys array<binary>, sizes array<int>, names array<string>,"
    " sources array<int>, n array<long>, docs array<long>"
)


def terms(text: str) -> list[bytes]:
    """Runs of A-Z, a-z and characters beyond ASCII, with only A-Z lowered."""
    return text.encode().translate(_LETTERS).split()


def _key(lang: str) -> bytes:
    """What stands before a term, so that terms of different languages never meet."""
    return len(lang.encode()).to_bytes(4, "big") + lang.encode()


def _term(key: bytes) -> tuple[str, str]:
    cut = 4 + int.from_bytes(key[:4], "big")
    return key[4:cut].decode(), key[cut:].decode()


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values)


def _pages(shard: np.ndarray, run: int, names: list[str], keys: list[bytes], rows: list[np.ndarray]) -> pa.RecordBatch:
    """Sorted keys and the rows (key, source, n, docs) of their postings as one page a shard.

    Keys are in the order of their shards, and rows in the order of their keys.
    """
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    key_ends = np.append(starts[1:], len(keys))
    place, source, n, docs = rows
    sizes = np.bincount(place, minlength=len(keys))
    ends = np.cumsum(sizes)[key_ends - 1]
    names = pa.array(names, pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard[starts].astype(np.int32)),
            pa.array(np.full(len(starts), run, np.int64)),
            _lists(pa.array(keys, pa.binary()), key_ends),
            _lists(pa.array(sizes.astype(np.int32)), key_ends),
            _lists(pa.concat_arrays([names] * len(starts)), len(names) * np.arange(1, len(starts) + 1)),
            _lists(pa.array(source.astype(np.int32)), ends),
            _lists(pa.array(n), ends),
            _lists(pa.array(docs), ends),
        ],
        names=["shard", "run", "keys", "sizes", "names", "sources", "n", "docs"],
    )


def _spill(block: dict, shards: int, run: int) -> pa.RecordBatch:
    """A block as one run: its terms sorted, and the postings behind each."""
    number = {source: k for k, source in enumerate(sorted({s for groups in block.values() for s in groups}))}
    keys, parts = [], []
    for lang, groups in block.items():
        listed = sorted(set().union(*(counts for counts, _ in groups.values())))
        # The empty term stands for the group itself, which may have no other.
        place = {w: len(keys) + k for k, w in enumerate([b"", *listed])}
        start = _key(lang)
        keys += [start + w for w in place]
        for source, (counts, spread) in groups.items():
            size = len(counts) + 1
            columns = [np.zeros(size, np.int64) for _ in range(4)]
            columns[0][0] = place[b""]
            columns[0][1:] = np.fromiter(map(place.__getitem__, counts), np.int64, size - 1)
            columns[1][:] = number[source]
            columns[2][1:] = np.fromiter(counts.values(), np.int64, size - 1)
            columns[3][1:] = np.fromiter(spread.values(), np.int64, size - 1)  # in the order of counts
            parts.append(columns)
    shard = np.fromiter((zlib.crc32(k) % shards for k in keys), np.int64, len(keys))
    by_key = sorted(range(len(keys)), key=keys.__getitem__)
    by_key = np.array(by_key)[np.argsort(shard[by_key], kind="stable")]
    rank = np.empty(len(keys), np.int64)
    rank[by_key] = np.arange(len(keys))
    rows = [np.concatenate(c) for c in zip(*parts)]
    rows[0] = rank[rows[0]]
    order = np.argsort(rows[0], kind="stable")
    return _pages(shard[by_key], run, list(number), [keys[k] for k in by_key], [c[order] for c in rows])


def _runs(shards: int, block_size: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, run = {}, 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for part in slices(batch, "text"):
                for text, lang, source in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "source"))):
                    counts, spread = block.setdefault(lang, {}).setdefault(source, (Counter(), Counter()))
                    words, before = terms(text), len(counts)
                    distinct = dict.fromkeys(words)
                    counts.update(words)
                    spread.update(iter(distinct))  # new terms enter both in the same order
                    held += len(counts) - before + sum(len(w) for w in distinct if len(w) > LONG) // LONG
                    if held >= block_size:
                        yield _spill(block, shards, run)
                        block, held, run = {}, 0, run + 1
        if block:
            yield _spill(block, shards, run)
        block = None
        give_back()

    return index


def _merged(table: pa.Table) -> tuple[list[str], list[bytes], list[np.ndarray]]:
    """Some runs of a shard as one: source names, sorted keys, and rows (key, source, n, docs).

    The heap holds one key of every run; postings follow as arrays and equal ones are added up.
    """
    table = table.combine_chunks()
    columns = {c: table[c].chunk(0) for c in table.column_names}  # a group has a row at least
    name_of = columns["names"].flatten().dictionary_encode()
    names = name_of.dictionary.to_pylist()
    name_starts = np.cumsum([0, *(len(x) for x in columns["names"])])
    codes = name_of.indices.to_numpy()
    counts = np.diff(columns["sources"].offsets.to_numpy())
    source = codes[np.repeat(name_starts[:-1], counts) + columns["sources"].flatten().to_numpy()]

    first = np.cumsum([0, *(len(x) for x in columns["keys"])]).tolist()
    listed = columns["keys"].flatten().to_pylist()
    sorted_runs = [zip(listed[a:b], range(a, b)) for a, b in zip(first, first[1:])]
    order, at, keys, last = np.empty(len(listed), np.int64), np.empty(len(listed), np.int64), [], None
    for k, (key, position) in enumerate(heapq.merge(*sorted_runs)):
        if key != last:
            keys.append(key)
            last = key
        order[k], at[k] = position, len(keys) - 1

    sizes = columns["sizes"].flatten().to_numpy().astype(np.int64)
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    gathered = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    cell = np.repeat(at, sizes) * max(len(names), 1) + source[gathered]
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    bounds = np.flatnonzero(np.diff(cell, prepend=-1))
    n, docs = (
        np.add.reduceat(columns[c].flatten().to_numpy()[gathered][order], bounds) if len(bounds) else np.zeros(0, np.int64)
        for c in ("n", "docs")
    )
    cell = cell[bounds]
    return names, keys, [cell // max(len(names), 1), cell % max(len(names), 1), n, docs]


def _merge_runs(key: tuple, table: pa.Table) -> pa.Table:
    """Some runs of a shard as one."""
    names, keys, rows = _merged(table)
    shard = np.full(len(keys), key[0].as_py(), np.int64)
    return pa.Table.from_batches([_pages(shard, key[1].as_py(), names, keys, rows)])


def _frequencies(least: int):
    def finish(table: pa.Table) -> pa.Table:
        """The last merge of a shard: whole terms, of which those in few documents go."""
        names, keys, (place, source, n, docs) = _merged(table)
        split = [_term(k) for k in keys]
        spread, total = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.add.at(spread, place, docs)
        np.add.at(total, place, n)
        keep = np.array([not word for _, word in split], bool) | (spread >= least)
        kept = np.flatnonzero(keep[place])
        place, chosen = place[kept], pa.array(place[kept])
        return pa.table(
            {
                "lang": pa.array([a for a, _ in split], pa.string()).take(chosen),
                "source": pa.array(names, pa.string()).take(pa.array(source[kept])),
                "term": pa.array([b for _, b in split], pa.string()).take(chosen),
                "n": pa.array(n[kept]),
                "lang_n": pa.array(total[place]),
                "first": pa.array((np.diff(place, prepend=-1) != 0).astype(np.int32)),
            }
        )

    return finish


def frequencies(
    docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", source: str = "source",
    block: int = BLOCK, merged: int = MERGED,
) -> DataFrame:
    """(lang, source, term, n, lang_n, first): counts of the terms in ``least`` documents of their language.

    ``lang_n`` is the count in the whole language, ``first`` is 1 on one row of each term and language.
    Every group has a row with the empty term and count 0.
    """
    spark = docs.sparkSession
    rows = docs.select(
        whole_text(text).alias("text"), whole_text(lang).alias("lang"), whole_text(source).alias("source")
    )
    scanned = rows.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0]
    shards = max(shuffle_parts(spark), min((scanned or 0) + 1, SHARDS))
    runs = cut_lineage(rows.mapInArrow(_runs(shards, block), _RUN))
    while True:
        size = runs.agg(F.count_distinct("run").alias("runs"), F.count("*").alias("pages"), F.sum(F.size("n")).alias("rows"))
        size = size.first()
        fan = max(2, int(merged * size["pages"] / max(size["rows"] or 0, 1)))
        if (size["runs"] or 0) <= fan:
            break
        batches = -(-size["runs"] // fan)
        keyed = runs.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(batches)))
        runs = cut_lineage(keyed.groupBy("shard", "run").applyInArrow(_merge_runs, _RUN))
    return runs.groupBy("shard").applyInArrow(_frequencies(least), "lang string, source string, term string, n long, lang_n long, first int")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exact; null without terms."""
    wide = F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + F.lit(2))
    whole = total + 2 * terms
    share = F.when(  # counts beyond this times 10^9 leave 64 bits
        n < 9_000_000_000, F.call_function("div", F.lit(1_000_000_000).cast("long") * (n + 2), whole)
    ).otherwise(F.call_function("div", wide, whole.cast("decimal(20,0)")))
    return F.lit(1) + F.when(whole > 0, share)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every two sources that share a term, how its part differs from that of an unshared one.

    Sums of pairs are held in arrays and sent on when there are too many of them.
    """
    names: dict[tuple[str, str], int] = {}
    keys, values, size = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, back, np.concatenate(values))
        return distinct, sums

    def send() -> Iterator[pa.RecordBatch]:
        distinct, sums = summed()
        listed = list(names)
        low, high = (distinct >> 32).tolist(), (distinct & 0xFFFFFFFF).tolist()
        columns = [[listed[k][0] for k in low], [listed[k][1] for k in low], [listed[k][1] for k in high]]
        arrays = [pa.array(c, pa.string()) for c in columns] + [pa.array(sums)]
        yield from pa.table(arrays, names=["lang", "source", "other", "value"]).to_batches(max_chunksize=100_000)

    def gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a - b) ** 2 // (a + b)

    for batch in batches:
        # Postings of all terms of a batch as arrays; a posting meets those behind it in its own term.
        found = batch.column("found")
        rows, sizes = found.flatten(), pc.list_value_length(found).to_numpy().astype(np.int64)
        langs = pc.take(batch.column("lang"), pa.array(np.repeat(np.arange(len(sizes)), sizes))).to_pylist()
        pairs = zip(langs, rows.field("source").to_pylist())
        number = np.fromiter((names.setdefault(pair, len(names)) for pair in pairs), np.int64, len(rows))
        p, none = (rows.field(f).to_numpy() for f in ("p", "none"))
        behind = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(rows))
        reach = np.cumsum(behind)
        start = 0
        while start < len(rows):
            done = reach[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(reach, done + CELLS, side="right")))
            i = np.repeat(np.arange(start, stop), behind[start:stop])
            j = i + 1 + np.arange(len(i)) - np.repeat(reach[start:stop] - behind[start:stop] - done, behind[start:stop])
            keys.append(number[i] << 32 | number[j])
            values.append(gap(p[i], p[j]) - gap(p[i], none[j]) - gap(none[i], p[j]) + gap(none[i], none[j]))
            size, start = size + len(i), stop
            if size >= CELLS:
                distinct, sums = summed()
                keys, values, size = [distinct], [sums], len(distinct)
                if size >= CELLS // 2:
                    yield from send()
                    keys, values, size = [], [], 0
    if keys:
        yield from send()


def audit(
    docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source",
    block: int = BLOCK, merged: int = MERGED,
) -> DataFrame:
    """(lang, source, part, item, value, rank): sources that differ, and the terms that mark a source.

    ``pair`` rows name every other source of the language, ``term`` rows the ``top`` kept terms that
    the source uses more than its language. Larger values rank first, equal ones by the bytes of the
    item. Null text, language and source count as ''. Repeated rows count each time. A language
    without kept terms has pairs of value 0 and no terms, a source alone in its language no pairs, an
    empty table no rows; other columns are not read. Two sources of a language whose names are equal
    are one.
    """
    found = cut_lineage(frequencies(docs, least, text, lang, source, block, merged))
    used = found.where("term != ''")
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    groups = found.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left")
    whole = used.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("first").alias("terms"))
    zero = F.lit(0).cast("long")
    groups = groups.join(whole, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "used", "lang_total", "terms")]
    )
    groups = cut_lineage(groups.withColumn("none", _share(zero, F.col("total"), F.col("terms"))))
    sized = broadcast_if_small(groups)

    shares = used.join(sized, ["lang", "source"]).select(
        "lang", "source", "term", "n", "none",
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    shares = cut_lineage(shares)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")
    )
    marks = marks.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # What each source's own terms give beside a source that has none of them.
    others = broadcast_if_small(groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none")))
    own = shares.groupBy("lang", "source", "p").count().join(others, "lang").where("source != other")
    own = own.groupBy("lang", "source", "other").agg(F.sum(F.col("count") * _gap(F.col("p"), F.col("other_none"))).alias("value"))
    both = groups.alias("a").join(broadcast_if_small(groups).alias("b"), F.expr("a.lang = b.lang and a.source < b.source"))
    unused = F.expr("a.terms - a.used - b.used") * _gap(F.col("a.none"), F.col("b.none"))
    start = both.select("a.lang", "a.source", F.col("b.source").alias("other"), F.coalesce(unused, zero).alias("value"))
    posted = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "none"))).alias("found"))
    posted = posted.where(F.size("found") > 1).select("lang", "found")
    shared = posted.mapInArrow(_correct, "lang string, source string, other string, value long")
    parts = start.unionByName(own).unionByName(shared)
    pairs = parts.groupBy(
        "lang", F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high")
    ).agg(F.sum("value").alias("value"))
    ends = F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("low", "high"), ("high", "low"))])
    pairs = pairs.select("lang", F.explode(ends).alias("two"), "value")
    pairs = pairs.select("lang", "two.source", F.lit("pair").alias("part"), "two.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(marks).select("lang", "source", "part", "item", "value", "rank")

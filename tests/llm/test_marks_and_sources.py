"""Fill-in-middle, SimHash classes and source divergence against brute force, SQL and awkward rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rankwell.llm import divergence, fim, simhash
from rankwell.llm.common import ship_package
from rankwell.llm.queries import ORACLES

DOCS = "doc_id long, text string, lang string, source string, fp string, output string, n int, shard int"
WORDS = "the of and river Stone cloud winter garden letter Signal engine window élan Übung 漢字 σίγμα".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [t.replace("river", "RIVER", 1) + " end" for t in texts[:30]] + texts[:10]
    texts += [None, "", " \t\n", "a", "the of", "x\x00y\x1fz", "<P> in it", "<S", "😀 é́ 漢字 ", "q" * 900, "!!!! ????"]
    texts += ["long " * 40_000, "é" * 70_000]
    rows = [(k, t, rng.choice(["en", "de", None, "xx"]) if k % 40 else "lone", rng.choice(["a", "b", "c", None, "é"])) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a text without a key", None, None), (None, None, "en", "zz")]
    return [(*r, "f", "o", 1, 2) for r in rows]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    ship_package(spark)
    return spark.createDataFrame([], DOCS)


def sql(name, docs):
    documents = docs.select("doc_id", "text", "lang", "source").toArrow()  # noqa: F841
    return sorted(map(repr, duckdb.sql(ORACLES[name]).fetchall()))


def listed(df, *columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def test_rearranged_texts_agree_with_sql(docs, nothing):
    found = fim.restored(fim.rearranged(docs)).cache()
    digests = found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
    assert listed(digests, *digests.columns) == sql("op12_fill_in_middle", docs)
    forms = {r["form"] for r in found.collect()}
    assert forms == {"plain", "psm", "spm"}
    assert all(r["form"] == "plain" for r in found.where("output like '%<P> in it%'").collect())
    assert fim.restored(fim.rearranged(nothing)).count() == 0


def test_every_cut_is_restored():
    for text in ("", "a", "<S", ">é漢", "<P<S><", "ab\x00cd"):
        coded = text.encode()
        bounds = [len(text[:k].encode()) for k in range(len(text) + 1)]
        for a, b in itertools.combinations_with_replacement(bounds, 2):
            want = {"psm": (fim.P, coded[:a], fim.S, coded[b:], fim.M, coded[a:b]), "spm": (fim.S, coded[b:], fim.P, coded[:a], fim.M, coded[a:b])}
            for form, parts in want.items():
                output = fim.arrange(coded, a, b, form)
                assert output == b"".join(parts)
                if "<S>" not in text:
                    assert fim.restore(bytes(output), form) == coded


def test_rotation_exchanges_blocks():
    for n, m in itertools.product(range(4), range(4)):
        buffer = bytearray(b"xx" + b"abc"[:n] + b"123"[:m] + b"yy")
        fim.rotate(buffer, 2, 2 + n, 2 + n + m)
        assert buffer == b"xx" + b"123"[:m] + b"abc"[:n] + b"yy"


def print_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints):
    """The smallest member each distinct print reaches, by comparing all."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 2:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("bucket", [2048, 2])
def test_components_agree_with_all_pairs(docs, nothing, rows, bucket):
    prints = [print_of(r[1]) for r in rows]
    classes, least = classes_of(set(prints)), {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[classes[p]] = min(least.get(classes[p], r[0]), r[0])
    want = sorted(repr((r[0], f"{p:016x}", least.get(classes[p]))) for r, p in zip(rows, prints))
    found = simhash.near_components(docs, bucket=bucket)
    assert listed(found, "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_components(nothing).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    for masks, places in [(simhash.MASKS, range(64))] + [
        (deeper, [b for b in range(64) if not mask >> b & 1]) for mask, deeper in zip(simhash.MASKS, simhash.DEEPER)
    ]:
        for a, b in itertools.combinations_with_replacement(places, 2):
            assert any(not m & (1 << a | 1 << b) for m in masks)
    for mask, deeper in zip(simhash.MASKS, simhash.DEEPER):
        assert all(m & mask == mask and 64 - m.bit_count() <= 12 for m in deeper)


@pytest.mark.parametrize("bucket", [2048, 64])
def test_links_of_a_dense_group(spark, bucket):
    """Fingerprints around two centres: every class is found, also where buckets are covered again."""
    ship_package(spark)
    rng, prints = random.Random(3), set()
    for centre in (0, rng.getrandbits(64)):
        for _ in range(700):
            p = centre
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    want = classes_of(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.linked_prints(spark.createDataFrame(signed, "fp long"), bucket).distinct().collect()
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
        low, high = sorted((find(a), find(b)))
        root[high] = low
    groups = lambda of: sorted(sorted(q for q in prints if of(q) == p) for p in {of(q) for q in prints})
    assert groups(find) == groups(want.get)


def test_majority_counts_long_texts_in_parts(monkeypatch):
    texts = ["", "one", "a b c d e f g h " * 40, "x y", "p q r s t " * 25]
    want = [print_of(t) for t in texts]
    monkeypatch.setattr(simhash, "HASHED", 64)
    assert simhash.majority([simhash.shingle_hashes(t) for t in texts]).tolist() == want


@pytest.mark.parametrize("block,merged", [(400_000, 2_000_000), (40, 30)])
def test_audit_agrees_with_sql(docs, nothing, block, merged):
    found = divergence.audit(docs, block=block, merged=merged)
    want = sql("op13_source_divergence", docs)
    assert listed(found, "lang", "source", "part", "item", "value", "rank") == want
    assert any("'term'" in r for r in want) and any("'lone'" in r for r in want)
    assert divergence.audit(nothing).count() == 0


def test_audit_without_kept_terms(docs):
    found = divergence.audit(docs, least=10_000).collect()
    assert found and all(r["part"] == "pair" and r["value"] == 0 for r in found)
    ranked = [r["item"] for r in sorted(found, key=lambda r: r["rank"]) if (r["lang"], r["source"]) == ("en", "a")]
    assert ranked == sorted(ranked, key=str.encode)


def test_terms_lower_only_ascii():
    assert divergence.terms("Ab1cD É-É \x7f\x80x İ") == [w.encode() for w in ("ab", "cd", "É", "É", "\x80x", "İ")]


def test_corrections_are_summed_whatever_the_batch(monkeypatch):
    rng = random.Random(1)
    kind = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("none", pa.int64())]))
    found = [
        [(s, rng.randint(3, 10**9), 2) for s in sorted(rng.sample("abcdefgh", rng.randint(2, 8)))] for _ in range(40)
    ]
    batch = pa.record_batch({"lang": pa.array(["x", "y"] * 20), "found": pa.array(found, kind)})

    def sums():
        total = Counter()
        for out in divergence._correct(iter([batch, batch])):
            for lang, low, high, value in zip(*(c.to_pylist() for c in out.columns)):
                total[lang, *sorted((low, high))] += value
        return total

    want = sums()
    monkeypatch.setattr(divergence, "CELLS", 3)
    assert sums() == want and len(want) == 2 * 28


def test_share_of_very_large_counts(spark):
    rows = [(n, total, terms) for n in (0, 5, 9_000_000_000, 4 * 10**18) for total, terms in ((7, 3), (9 * 10**18, 10**5), (0, 0))]
    df = spark.createDataFrame(rows, "n long, total long, terms long").where("n <= 100 or total > 100")
    shares = df.select("*", divergence._share(F.col("n"), F.col("total"), F.col("terms")).alias("p")).collect()
    for r in shares:
        whole = r["total"] + 2 * r["terms"]
        assert r["p"] == (1 + 10**9 * (r["n"] + 2) // whole if whole else None)


def test_hash_of_a_document_does_not_depend_on_its_text():
    assert fim.choose(5, "abc", 1)[0] == fim.choose(5, "xyz", 1)[0]
    name = hashlib.sha256(b"1:5").hexdigest()
    cuts = sorted(int(name[k : k + 8], 16) % 4 for k in (0, 8))
    assert fim.choose(5, "abc", 1)[1:] in (tuple(cuts), (0, 0))

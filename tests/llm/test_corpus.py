"""Corpus operators against the libraries, brute force, round trips and awkward rows."""

import base64
import hashlib
import random
import textwrap
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankwell.llm import (
    bpe, counts, decontam, exact, html_blocks, html_crf, jaccard, langid, licences, pieces, simple8b, tokens, weak_quality,
)
from rankwell.llm.common import may_hold, ship_package, without
from rankwell.llm.queries import ORACLES

WORDS = "the of and river stone cloud winter garden letter signal engine window market bridge forest".split()
DOCS = "doc_id long, text string, lang string, print string, score int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    base = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 120))) for _ in range(30)]
    near = [" ".join([*b.split()[:-1], "changed"]) for b in base[:8]]
    odd = [None, "", " ", "a", "the of", "x  y\n z\t ", "don't WE'LL <|endoftext|> 12ab é́ 漢字 😀", "q" * 700, "\x1f \x1f", "!!!! ????"]
    return base + near + base[:5] + odd + ["word " * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Rows with copies, a repeated row, null keys and columns that clash with results."""
    ship_package(spark)
    rows = [(k, t, "en", "p", 1) for k, t in enumerate(texts)]
    rows += [rows[0], (None, "a text without a key", None, "p", 2)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    ship_package(spark)
    return spark.createDataFrame([], DOCS)


def by_key(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("top", [1, 2, 60, 1 << 16, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 4000):
        values = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
        words, offsets = simple8b.encode(values)
        assert (simple8b.decode(words, offsets, n) == values).all()


def test_token_files(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, start, want = Tokenizer.from_file(path), 0, []
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(want, key=str) == sorted(map(tuple, tokens.token_files(docs, path, 2).collect()), key=str)
    assert tokens.token_files(nothing, path, 2).count() == 0


def test_pieces_of_chunks_are_pieces_of_texts():
    rng = random.Random(1)
    parts = ["a", "b", " ", " ", "\n", "\t", "\x1f", "'s", "1", "!", ".", "é", "  ", "\r\n", "\x1c", "\x85", " the", "　"]
    given = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    chunks, places, firsts = pieces.chunk_texts(pa.array(given))
    split = [pieces.split_chunk(c) for c in pieces.strings(chunks)]
    flat, sizes = pieces.split_chunks(chunks)
    assert flat.to_pylist() == [p for part in split for p in part]
    assert sizes.tolist() == [len(part) for part in split]
    for text, a, b in zip(given, firsts, [*firsts[1:], len(places)]):
        assert [p for k in places[a:b] for p in split[k]] == pieces.split_pieces(text)


@pytest.mark.parametrize("common", [400_000, 5])
def test_token_counts(docs, nothing, common):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    want = []
    for key, text in docs.select("doc_id", "text").collect():
        n = len(whole.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 512))
    got = counts.token_counts(docs, path, common=common)
    assert by_key(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=lambda r: (r[0] is None, r))
    assert counts.token_counts(nothing, path).count() == 0


@pytest.mark.parametrize("common", [1_500_000, 3])
def test_bpe(docs, nothing, common):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for key, text in docs.select("doc_id", "text").collect():
        ids = np.array(whole.encode_ordinary(text or ""), "<u4")
        want.append((key, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.encode_decode(docs, path, common=common)
    assert by_key(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=lambda r: (r[0] is None, r))
    assert bpe.heap_merges(("thering" * 60).encode(), ranks) == whole.encode_ordinary("thering" * 60)
    assert bpe.encode_decode(nothing, path).count() == 0


def test_exact_groups_agree_with_sql(docs, nothing):
    documents = docs.where("doc_id is not null").select("doc_id", "text").toPandas()
    want = sorted(duckdb.sql(ORACLES["op10_exact_dedup"]).fetchall())
    got = exact.exact_groups(docs.where("doc_id is not null")).drop("print")
    assert len(documents) and sorted(map(tuple, got.collect())) == want
    assert exact.exact_groups(nothing).count() == 0
    alone = exact.exact_groups(docs).where("doc_id is null").first()
    assert alone.kept and alone.group_size == 1


def test_golomb_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        values = np.unique(rng.integers(0, 1 << 60, n, dtype=np.uint64))
        shift = exact.golomb_shift(len(values), float(1 << 60))
        assert (exact.golomb_decode(exact.golomb_encode(values, shift), len(values), shift) == values).all()


@pytest.mark.parametrize("block,bucket", [(2048, 50_000), (4, 3)])
def test_similar_classes_agree_with_all_pairs(docs, nothing, block, bucket):
    shingle = jaccard.Shingler()
    rows = docs.where("doc_id is not null").select("doc_id", "text").distinct()
    sets = {r.doc_id: set(shingle(r.text or "").tolist()) for r in rows.collect()}
    links, root = dict.fromkeys(sets, 0), {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                one, two = sorted((top(a), top(b)))
                root[two] = one
    got = by_key(jaccard.similar_classes(rows, block=block, bucket=bucket), "doc_id", "class_id", "n_links")
    assert got == sorted((k, top(k), links[k]) for k in sets)
    assert jaccard.similar_classes(nothing).count() == 0


def passage_pairs(n):
    """Pairs of texts at a similarity just over 0.8 whose common part is passages that most others share."""
    rng = random.Random(11)
    out = []
    for _ in range(n):
        chosen = [(slot, int(rng.random() < 0.3)) for slot in range(40)]
        common = " ".join(" ".join(f"p{slot}v{kind}w{k}" for k in range(12)) for slot, kind in chosen)
        out += [" ".join([common, *(f"e{rng.randint(0, 10**9)}" for _ in range(56))]) for _ in range(2)]
    return out


def test_pairs_in_large_buckets_are_met(spark):
    ship_package(spark)
    given = passage_pairs(30)
    shingle = jaccard.Shingler()
    sets = [set(shingle(x).tolist()) for x in given]
    assert all(0.8 <= len(a & b) / len(a | b) < 0.83 for a, b in zip(sets[::2], sets[1::2]))
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    got = by_key(jaccard.similar_classes(docs, small=2), "doc_id", "class_id", "n_links")
    assert got == [(k, k - k % 2, 1) for k in range(len(given))]


def test_recall_where_most_share_passages():
    """Pairs at 0.8 whose common coordinates most others share: eight runs lose several of them."""
    rng, pairs = np.random.default_rng(7), 800
    kinds = (rng.random((pairs, 40)) < 0.3).astype(int)
    passages = 1 - rng.random((40, 2, jaccard.COORDINATES)) ** (1 / 12)
    common = np.min([passages[k, kinds[:, k]] for k in range(40)], axis=0)
    halves = [np.minimum(common, 1 - rng.random(common.shape) ** (1 / 60)) for _ in range(2)]
    hashes = (np.concatenate(halves) * (1 << 36)).astype(np.uint64).astype("<u4")
    rows, deep, met = np.arange(2 * pairs), np.zeros(2 * pairs, np.int32), np.zeros(pairs, bool)
    run = 0
    while run < jaccard.runs_for(jaccard.RECALL, max(2, int(deep.max()))):
        run += 1
        edges = []
        jaccard._split(run, rows, hashes, rows, 0, jaccard.DEPTH, 2, edges, deep)
        head = {}
        for a, b in edges:
            head.setdefault(a, {a}).add(b)
        for group in head.values():
            met[[k for k in group if k < pairs and k + pairs in group]] = True
        if run == 8:
            assert not met.all()
    assert met.all()


def test_language(spark, nothing):
    ship_package(spark)
    rng = random.Random(5)
    kinds = {"xx": "aba bab aab bba abab".split(), "yy": "cdc dcd ccd ddc cdcd".split()}
    rows = [(k, " ".join(rng.choice(kinds[x]) for _ in range(40)), x) for k, x in enumerate(["xx", "yy"] * 40)]
    rows += [(900, None, "xx"), (901, "123 ...", "yy"), (902, "", None), (903, "aba bab bba " * 3 + "cdc " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_of(docs).collect()}
    assert all(got[k].lang_pred == x for k, _, x in rows[:80])
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "yy"]
    assert got[903].lang_set == ["yy", "xx"] and 0.5 < got[903].score < 1
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert langid.language_of(nothing).count() == 0


def test_decontamination(spark, nothing):
    ship_package(spark)
    rng = random.Random(6)
    item = [" ".join(f"{rng.choice(WORDS)}{rng.randint(0, 99)}" for _ in range(20)) + ". The answer is stone7 river9." for _ in range(9)]
    items = spark.createDataFrame([*enumerate(item), (97, None), (98, "")], "item_id long, text string")
    filler = " ".join(f"{w}{k}" for k, w in enumerate(WORDS * 10))
    rows = [(1, filler), (2, f"{filler} {item[3]} {filler}"), (3, None), (4, ""), (5, item[5].upper()), (6, item[7][:60])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (1_000_000, 40):
        got = decontam.contaminated(docs, items, shard_words=shard)
        assert by_key(got, "doc_id", "item_id") == [(2, 3), (5, 5)]
    assert decontam.contaminated(nothing, items).count() == 0
    assert decontam.contaminated(docs, items.where("item_id < 0")).count() == 0


def test_edited_and_cut_copies_of_items(spark):
    ship_package(spark)
    rng = random.Random(16)
    rows, items = [], []
    for k, (size, last) in enumerate([(30, 1), (30, 2), (30, 4), (30, 7), (110, 1), (110, 4)]):
        body = [f"{rng.choice(WORDS)}{rng.randint(0, 9999)}" for _ in range(size)]
        answer = [f"{rng.choice(WORDS)}{rng.randint(0, 9999)}" for _ in range(last)]
        items.append((k, f"{' '.join(body)}. {' '.join(answer)}."))
        changed = [*answer[: last // 2], "other", *answer[last // 2 + 1 :]]
        rows += [(10 * k, f"{' '.join(body)}. {' '.join(changed)}."), (10 * k + 1, " ".join(body)), (10 * k + 2, items[-1][1])]
        rows.append((10 * k + 3, " ".join(x for w in body for x in (w, "between"))))
    got = decontam.contaminated(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert by_key(got, "doc_id", "item_id") == [(10 * k + n, k) for k in range(len(items)) for n in range(3)]


def test_wand_finds_what_scoring_all_finds():
    rng = random.Random(8)
    units = [[rng.choice(WORDS) + str(rng.randint(0, 5)) for _ in range(rng.randint(3, 30))] for _ in range(150)]
    idf = {w: 1 + len(w) / 3 for u in units for w in u}
    index = decontam.Index.build(list(range(150)), [0] * 150, units, [3] * 150, idf, 15.0)
    for unit in units[:40]:
        query = sorted({index.terms[w] for w in rng.sample(unit, min(len(unit), 8)) + rng.choice(units)})
        want = {}
        for t in query:
            for u, weight in zip(index.postings[t], index.impacts[t]):
                want[u] = want.get(u, 0) + weight
        for threshold in (0.2, 0.5):
            assert {u for u, _ in index.search(query, threshold)} == {u for u, s in want.items() if s >= threshold - 1e-9}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies here.</div><article><h1>Head &amp; tail</h1><p>First <b>bold
<br>words</b>  here and some more of them.<p>Second paragraph is not closed &eacute;.<div class="ad">Buy now</div></article>
<script>var a = "<p>no</p>";</script><div class="comments"><p>Nice text, thank you.</p></div><footer>&copy; us</footer>"""


def test_html(spark):
    ship_package(spark)
    rows = [(k, "u", PAGE) for k in range(12)] + [(90, None, None), (91, "u", ""), (92, "u", "<<< <p>&amp")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_crf.extract(pages).collect()}
    want = "Head & tail\nFirst bold words here and some more of them.\nSecond paragraph is not closed é."
    assert got[0].text == want and got[0].n_chars == len(want) and got[90].text == got[91].text == ""
    assert len(got) == 15
    assert html_crf.extract(pages.where("page_id < 0")).count() == 0
    assert [b.text for b in html_blocks.blocks_of("a<div>b</p>c</div>d<br>e")] == ["a", "b", "c", "d e"]


def test_quality(spark, nothing):
    ship_package(spark)
    rng = random.Random(9)
    good = [". ".join(" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(6)) + "." for _ in range(150)]
    bad = ["!! ".join(rng.choice(WORDS).upper() for _ in range(40)) + "!!" for _ in range(20)]
    bad += ["### ".join(rng.choice(WORDS) for _ in range(40)) + "$$$" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate([*good, *bad, "", None])), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in weak_quality.quality(docs).collect()}
    assert all(got[k] for k in range(150)) and not any(got[k] for k in range(150, 192))
    assert weak_quality.quality(nothing).count() == 0


def test_licences(spark, nothing):
    ship_package(spark)
    full = ". ".join(licences.SENTENCES[s] for s in ("mit.grant", "mit.notice", "mit.warranty")) + "."
    rows = [
        (1, "Some words.\nReleased under the MIT License.\nMore words."),
        (2, f"{full}\nLicensed under the Apache License, Version 2.0."),
        (3, "The license of nothing."), (4, None), (5, ""), (6, "Licensed under\nCC BY-NC 4.0."),
    ]
    got = by_key(licences.licences_of(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "licence", "version", "sentences")
    assert got == [(1, "MIT", None, 1), (2, "Apache", "2.0", 1), (2, "MIT", None, 3), (6, "CC-BY-NC", "4.0", 1)]
    assert licences.licences_of(nothing).count() == 0


def test_measures_read_the_whole_text():
    words = [f"a{k}" for k in range(300)] + [f"q{k}" for k in range(700)]
    assert weak_quality.measures(" ".join(words))["vowels"] == 0.3
    block = html_blocks.blocks_of("<p>" + "word " * 30 + "77</p>")
    assert html_crf._cell("number") in html_crf.features(block)[0]


LICENCE_TEXTS = {
    ("MIT", None, 3): (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated'
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED'
        " TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"
        " THE AUTHORS BE LIABLE.",
    ),
    ("GPL", "3", 2): (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License.",
    ),
    ("BSD-3-Clause", None, 4): (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution.",
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ),
    ("Apache", "2.0", 4): (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at",
        "https://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed'
        ' on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
}


@pytest.mark.parametrize("width", [24, 40, 80, 4000])
@pytest.mark.parametrize("sign", ["", " * ", "# ", "// ", "dnl ", "    "])
def test_wrapped_licences(width, sign):
    for want, parts in LICENCE_TEXTS.items():
        lines = [x for part in parts for x in [*textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False), ""]]
        text = "\r\n".join(sign + x for x in ["Copyright (c) 2020 Somebody", "", *lines])
        got = [(m[0], m[1], m[3]) for m in licences.match_rules(licences.identify(text))]
        assert got == [want]


def test_licences_named_inside_sentences(spark):
    ship_package(spark)
    rows = [
        (1, "This project is licensed under the MIT License."), (2, "It is not licensed under the MIT License."),
        (3, "One part is licensed under the MIT License, another is licensed under the MIT\n# License."),
        (4, "Copyright 2020 A, all rights reserved, but B is licensed under the GNU General Public Licence, version 3"),
    ]
    got = by_key(licences.licences_of(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "licence", "version", "times")
    assert got == [(1, "MIT", None, 1), (3, "MIT", None, 2), (4, "All rights reserved", None, 1), (4, "GPL", "3", 1)]


def test_bitmap_never_loses_a_row(docs):
    keys = docs.where("doc_id % 3 = 0").select("doc_id")
    held = may_hold(docs, keys, "doc_id")
    assert held.join(keys, "doc_id", "left_semi").count() == docs.join(keys, "doc_id", "left_semi").count()
    assert held.count() + may_hold(docs, keys, "doc_id", keep=False).count() == docs.count()
    gone = docs.where("doc_id < 9").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    assert without(docs, gone).count() == docs.where("doc_id >= 9 or doc_id is null").count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen.append(docs.count())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert seen == sorted(seen, reverse=True) and seen[3] == seen[4] == corpus_pipeline.run(spark, folder).count()


def test_bpe_rank_table_is_in_no_plan_text(spark, nothing):
    """The driver keeps the texts of many plans, so a table of megabytes must not be spelled out in them."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    words = spark.createDataFrame([(["thering", "", "\u6f22"],)], "words array<string>")
    folded = words.withColumn("ranks", bpe.rank_table(spark, ranks)).select(
        bpe.fold_merges(F.col("words"), F.col("ranks")).alias("ids")
    )
    run = folded._jdf.queryExecution()
    assert len(run.toString()) < 200_000
    assert "AS ranks" not in run.executedPlan().toString()  # no row carries the table
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert folded.first().ids == [whole.encode_ordinary(w) for w in ("thering", "", "\u6f22")]

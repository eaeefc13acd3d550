"""Block parser, label field and quality scorer: brute force, awkward rows, time in proportion."""

import itertools
import random
import time

import numpy as np
import pytest

from rankwell.llm import html_blocks, html_crf, weak_quality
from rankwell.llm.common import ship_package

WORDS = "the of and river stone cloud winter garden letter signal engine window market bridge forest".split()


def texts_of(page):
    return [b.text for b in html_blocks.blocks_of(page)]


@pytest.mark.parametrize("page, want", [
    ("<head><title>t</title><p>Some text here</p>", ["Some text here"]),
    ("<head><title>t</title><meta name=a><div>abc</div>", ["abc"]),
    ("<html><head><style>p{}</style></head>words <b>bold</b>", ["words bold"]),
    ("<p>x<math><mi>y</mi></math> z</p>", ["xy z"]),
    ("x <svg><title>no</title><path d='m'/><text>label</text></svg> y", ["x label y"]),
    ("<object>shown <p>too</p></object>", ["shown", "too"]),
    ('<div title="1 > 2">in</div>', ["in"]),
    ('<div title="open>in</div><p>next</p>', ["in", "next"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>a<p>b<ul><li>c<li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("", []), ("   ", []), ("<", ["<"]), ("a < b", ["a < b"]), ("</p></p>", []),
])
def test_blocks(page, want):
    assert texts_of(page) == want


@pytest.mark.parametrize("page", [
    lambda n: "<div class=x>y" * n, lambda n: "<" + "a" * n, lambda n: "<a" * n, lambda n: '<a "><a" ' * n,
    lambda n: "<b>x</b><b><p>y" * n, lambda n: "<ul><li>" + "<ul><div>" * n + "<li>x</li>" * n,
    lambda n: "".join(f"<div class=k{i}>y" for i in range(n)), lambda n: "<i>" * n + "</p>x" * n,
])
def test_pages_of_any_depth_take_seconds(page):
    field = html_crf.Field()
    start = time.time()
    blocks = html_blocks.blocks_of(page(100_000))
    if blocks:
        assert len(field.decode(field.page_scores(blocks))) == len(blocks)
    assert time.time() - start < 60


def all_labellings(field, scores):
    """(labels, score) of every labelling."""
    for labels in itertools.product((0, 1), repeat=len(scores)):
        value = field.edge[0, labels[0]] + field.edge[1, labels[-1]] + sum(s[y] for s, y in zip(scores, labels))
        yield labels, value + sum(field.step[a, b] for a, b in itertools.pairwise(labels))


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_viterbi_and_marginals_agree_with_all_labellings(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        field = html_crf.Field()
        field.step, field.edge, scores = rng.normal(size=(2, 2)), rng.normal(size=(2, 2)), rng.normal(size=(n, 2))
        every = list(all_labellings(field, scores))
        assert tuple(field.decode(scores)) == max(every, key=lambda x: x[1])[0]
        total = sum(np.exp(v) for _, v in every)
        single, pairs = field.expected(scores)
        want = np.array([[sum(np.exp(v) for y, v in every if y[k] == label) / total for label in (0, 1)] for k in range(n)])
        steps = np.array([[sum(np.exp(v) * list(itertools.pairwise(y)).count((a, b)) for y, v in every) / total for b in (0, 1)] for a in (0, 1)])
        assert np.allclose(single, want) and np.allclose(pairs, steps)


def test_page_scores_are_the_sums_of_the_features():
    rng = np.random.default_rng(2)
    field = html_crf.Field()
    field.state = rng.normal(size=field.state.shape)
    page = "<html><body><nav id=top><a href=x>Home</a></nav><main class='main ad'><div class=ad><p>One two 3</p></div><p>Four</main>"
    blocks = html_blocks.blocks_of(page + "<footer><footer class=ad>© us")
    assert len(blocks) == 4 and np.allclose(field.page_scores(blocks), field.scores(html_crf.features(blocks)))


def test_pages_with_awkward_rows(spark):
    ship_package(spark)
    page = "<nav><a href=/>Home</a></nav><article><p>Some words of the article, long enough.</p></article>"
    rows = [(1, "u", page, "x", 1.0)] * 2 + [(None, None, page, "y", 2.0), (2, "u", None, None, None), (3, "u", "w " * 200_000, "", 0.0)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars double")
    got = sorted(html_crf.extract(table).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [r.page_id for r in got] == [1, 1, 2, 3, None]
    assert {got[k].text for k in (0, 1, 4)} == {"Some words of the article, long enough."} and got[2].text == ""
    assert got[3].n_chars == len(got[3].text) and [f.name for f in html_crf.extract(table).schema] == ["page_id", "url", "text", "n_chars"]


def test_posteriors_agree_with_expectation_maximisation_over_rows():
    """The same model fitted row by row in plain Python."""
    rng = random.Random(3)
    rows = [tuple(rng.choice((0, 1, 2) if k < 2 else (0, 1)) for k in range(len(weak_quality.LABELLERS))) for _ in range(300)]
    codes = np.array([weak_quality.pattern_of(r) for r in rows])
    model = weak_quality.LabelModel.fit(*np.unique(codes, return_counts=True))
    expected = [[[0.4, 0.4, 0.2]] * len(rows[0]), [[0.49, 0.01, 0.5]] * len(rows[0])]
    rates, prior, hold = expected, 0.8, 0.01 * len(rows)
    for _ in range(weak_quality.ROUNDS):
        good = []
        for row in rows:
            like = [p * np.prod([rates[y][k][v] for k, v in enumerate(row)]) for y, p in ((0, 1 - prior), (1, prior))]
            good.append(like[1] / sum(like))
        sums = [[[hold * x for x in e] for e in part] for part in expected]
        for row, g in zip(rows, good):
            for k, v in enumerate(row):
                sums[0][k][v] += 1 - g
                sums[1][k][v] += g
        rates = [[[x / sum(e) for x in e] for e in part] for part in sums]
        prior = min(0.99, max(0.01, (sum(good) + 1) / (len(rows) + 2)))
    like = [[p * np.prod([rates[y][k][v] for k, v in enumerate(r)]) for y, p in ((0, 1 - prior), (1, prior))] for r in rows]
    assert np.allclose(model.posterior(codes), [b / (a + b) for a, b in like], atol=1e-4)


def test_text_that_is_bad_only_by_its_words(spark):
    """Two thirds of the bad texts also have signs that labellers see; the rest differ in words alone."""
    ship_package(spark)
    rng = random.Random(6)
    foul = [f"junk{k}" for k in range(25)]

    def text(words, signs=""):
        return " ".join(f"{' '.join(rng.choice(words) for _ in range(9))}{signs}." for _ in range(6))

    good = [text(WORDS) for _ in range(240)]
    seen = [text(WORDS + foul * 2, " ### $$$ %%% ***") for _ in range(60)]
    unseen = [text(WORDS + foul * 2) for _ in range(15)]
    docs = spark.createDataFrame(list(enumerate([*good, *seen, *unseen])), "doc_id long, text string")
    got = {r.doc_id: r for r in weak_quality.quality(docs).collect()}
    assert all(got[k].kept for k in range(240)) and not any(got[k].kept for k in range(240, 300))
    assert all(got[k].posterior > 0.5 for k in range(300, 315))  # no labeller sees them
    worst_good = np.quantile([got[k].score for k in range(240)], 0.02)
    assert np.mean([got[k].score < worst_good for k in range(300, 315)]) >= 0.8


def test_quality_with_awkward_rows(spark):
    ship_package(spark)
    plain = "A plain sentence of some words stands here. " * 3
    rows = [(1, plain, 5, "a")] * 2 + [(None, plain, 6, "b"), (2, None, 7, None), (3, " \n", 8, "c"), (4, "word " * 200_000, 9, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, h string")
    got = weak_quality.quality(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 2, None: 1, 2: 1, 3: 1, 4: 1}
    assert by[1][0] == by[1][1] and by[1][0].score == by[None][0].score
    assert by[2][0].score == by[3][0].score == 0 and not by[2][0].kept


def test_cells_are_those_of_every_word_and_pair():
    words = [f"w{k}" for k in range(500)] + ["W1", "w2."]
    cells = weak_quality.cells_of(" ".join(words), weak_quality.Cells())
    n, size = len(words), weak_quality.CELLS
    assert len(cells) == 3 * n - 1 and cells[0] < size <= cells[n] < 2 * size <= cells[-1] < weak_quality.BIAS
    assert cells[1] == cells[n - 2] and cells[2] == cells[n - 1]  # case and end signs do not matter
    assert len(weak_quality.cells_of("", weak_quality.Cells())) == 0

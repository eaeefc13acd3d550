"""Work whose intermediate rows must not grow with the product of its sides."""

import random
from collections import Counter

from pyspark.sql import functions as F

from rankwell.functions import company, text
from rankwell.operators import fuzzy, reports, scoring


def test_grams_are_those_of_the_pattern(spark):
    texts = ["", "a", "Abc abc", "é😀x😀😀", "?😀", "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "title string")
    for row in df.select("title", fuzzy._padded().alias("p"), fuzzy.trigrams(F.col("title")).alias("g")).collect():
        numbers = [ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in row["g"]]
        assert Counter(numbers) == Counter(fuzzy._grams(row["p"]).tolist())


def test_long_titles_of_common_trigrams_hardly_meet(spark):
    """All trigrams are in all titles, so any two share their rarest ones; a few pairs are alike."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((80, 90, 700)))) for _ in range(160)]
    texts += [t[:-9] + "dcba" for t in texts[:30]] + [t.replace("abc", "dd", 1) for t in texts[30:50]]
    rows = [(t, "x" if i % 5 else "y", k % 2 == 0) for k, (i, t) in enumerate(enumerate(texts))]
    rows += [(texts[0], None, True), (None, "x", False), (texts[7], "x", True), (texts[7], "x", False)]
    df = spark.createDataFrame(rows, "title string, block string, is_new boolean")
    new, old = df.where("is_new"), df.where("not is_new")

    def grams(s):
        s = f"  {s}  "
        return Counter(s[i:i + 3] for i in range(len(s) - 2))

    counted = {t: grams(t) for t in texts}
    want, compared = set(), 0
    for a, x, fresh in rows:
        for b, y, other in rows:
            if a and b and x == y and x and fresh and not other:
                shared = sum((counted[a] & counted[b]).values())
                compared += 1
                score = shared / (counted[a].total() + counted[b].total() - shared)
                if score > 0.85:
                    want.add((x, a, b, score))
    found = [tuple(r) for r in fuzzy.similar_titles(new, old).collect()]
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 20
    titles = fuzzy._titles(new, old)
    formed = [fuzzy.likely_pairs(titles, 0.85, size).count() for size in (512, 7)]
    assert formed[0] == formed[1] < compared / 10


def test_prepared_columns_of_pairs_are_not_shuffled(spark):
    pairs = spark.range(60).select((F.col("id") % 7).alias("user_id"), (F.col("id") % 5).alias("job_id"))
    jobs = spark.range(4).select(F.col("id").alias("job_id"), F.lit("j").alias("wide"))
    profiles = spark.range(6).select(F.col("id").alias("user_id"), F.lit("p").alias("p_wide"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = {few: scoring.given_pairs(pairs, jobs, profiles, few) for few in (0, 4, 6)}
        found["profiles"] = scoring.given_pairs(pairs, jobs.union(jobs.where("job_id > 90")).union(
            spark.range(50, 90).select("id", F.lit("j"))), profiles, 6)
        plans = {k: df._jdf.queryExecution().executedPlan().toString() for k, df in found.items()}
        assert "Broadcast" not in plans.pop(0) and all(p.count("BroadcastHashJoin") == 1 for p in plans.values())
        rows = {k: sorted((r["user_id"], r["job_id"], r["wide"], r["p_wide"]) for r in df.collect()) for k, df in found.items()}
    finally:
        spark.conf.set(threshold, kept)
    want = sorted({(i % 7, i % 5, "j", "p") for i in range(60) if i % 7 < 6 and i % 5 < 4})
    assert all(r == want for r in rows.values())


def test_previews_form_no_row_per_match(spark):
    rng = random.Random(4)
    pick = lambda *values: rng.choice([None, *values])
    feed = [(u, f"j{i:03}", float(rng.randint(60, 70)), pick("a", "b"), pick("IN", "US"), pick(1.0, 2.0, 3.0))
            for u in (1, 2, None) for i in range(120)]
    saved = [(i if i % 9 else 9, pick(1, 2, 3), pick("a", "b"), pick("IN", "US"), pick(1.0, 2.0, 3.0)) for i in range(60)]
    saved.append((None, 1, None, None, None))
    rows = spark.createDataFrame(
        feed, "user_id long, job_id string, final_score double, work_mode string, country_code string, salary_max double")
    searches = spark.createDataFrame(
        saved, "search_id long, user_id long, work_mode string, country_code string, min_salary double")
    hits = {}
    for sid, user, mode, country, least in saved:
        for u, j, score, m, c, most in feed:
            if (sid is not None and user is not None and user == u and mode in (None, m)
                    and country in (None, c) and (least is None or most is not None and most >= least)):
                hits.setdefault(sid, []).append((score, j))
    want = []
    for sid, *_ in saved:
        best = sorted(hits.get(sid, []), reverse=True)[:5]
        want += [(sid, len(hits[sid]), j, s, n) for n, (s, j) in enumerate(best, 1)] or [(sid, 0, None, None, None)]
    for size in ({}, {"block": 7, "share": 3}):
        found = [tuple(r) for r in reports.search_previews(searches, rows, **size).collect()]
        assert sorted(found, key=str) == sorted(want, key=str)


def test_company_keys_are_as_the_plain_patterns_give_them(apply):
    names = ["Acme Inc", "Inc", " acme--co. ltd ", "co", "Foo SA sas", "ﬁrm GmbH", "", "-", "Ångström AG", "private pvt", None,
             "Inc Acme", "Acme inco", "a-co-b co"]

    def plain(name):
        slug = F.regexp_replace(F.regexp_replace(F.lower(text.fold_accents(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
        return F.regexp_replace(slug, company._LEGAL_TAIL, "")

    assert apply(names, lambda v: company.company_slug(v, True)) == apply(names, plain)
    domains = ["https://www.a.io/x", "a://b.com", "1a://b.com", "x.a://b.com", "www.www.b.com", "b..-.com", " B.COM ", "://c.de", None]

    def part(domain):
        return company.hash_parts(F.lit("t"), F.lit("n"), domain, F.lit("c"), F.lit("m"))["company"]

    def before(domain):
        return text.hash_token(F.coalesce(company.domain_slug(domain), F.lit("n")))

    assert apply(domains, part) == apply(domains, before)
    assert apply(domains, company.domain_slug) == ["a.io", "b.com", None, "b.com", "www.b.com", "b..-.com", "b.com", None, None]


def test_titles_meet_whole_in_cells_of_any_size(spark, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.choice((60, 64)))) for _ in range(60)]
    rows = [(t[: len(t) - k] + "x" * k, "b", (n + k) % 2 == 0) for n, t in enumerate(texts) for k in range(3)] * 2
    df = spark.createDataFrame(rows, "title string, block string, is_new boolean")
    found = []
    for held, met, size in ((16_384, 32_768, 512), (9, 5, 3)):
        monkeypatch.setattr(fuzzy, "HELD", held)
        monkeypatch.setattr(fuzzy, "MET", met)
        titles = fuzzy._titles(df.where("is_new"), df.where("not is_new"))
        assert titles.count() == len({r[0] for r in rows})
        pairs = [tuple(r) for r in fuzzy.likely_pairs(titles, 0.85, size).collect()]
        assert len(pairs) == len(set(pairs)) > 20
        found.append(set(pairs))
    assert found[0] == found[1]


def test_a_block_is_sent_once_per_line_of_its_grid(spark):
    """Eight blocks that all meet eight others are sent eight times when sent per pair, here once."""
    titles = spark.range(4_000).select(
        F.lit("b").alias("block"), F.concat(F.lit("t"), F.format_string("%06d", "id")).alias("title"),
        (F.col("id") % 2 == 0).alias("in_new"), (F.col("id") % 2 == 1).alias("in_old"),
        F.unhex(F.md5(F.col("id").cast("string"))).alias("tid"),
    )
    sent = []
    whole = fuzzy.grid.meet
    try:
        fuzzy.grid.meet = lambda left, right, *rest: sent.extend(
            [left.select(F.explode("cells")).count(), right.select(F.explode("cells")).count()]
        ) or whole(left, right, *rest)
        fuzzy.likely_pairs(titles, 0.85, 250)
    finally:
        fuzzy.grid.meet = whole
    assert max(sent) <= 8

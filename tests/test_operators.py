import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rankwell.constants import STAGE_MOVES
from rankwell.operators import dedupe, fuzzy, merges, neighbours, ordered, scoring, tracker

NOW = "2024-06-01 00:00:00"
JOB = (
    "job_id string, title string, description_text string, company_name string, "
    "company_domain string, country_code string, work_mode string, remote_scope string, "
    "seniority string, salary_min double, salary_max double, salary_currency string, "
    "salary_period string, posted_at timestamp"
)
PROFILE = (
    "user_id long, seniority string, country_code string, work_modes array<string>, "
    "min_salary double, salary_currency string, salary_period string, "
    "blocked_companies array<string>, preferred_companies array<string>, "
    "excluded_keywords array<string>"
)


def job(spark, ident="j", **changes):
    from datetime import datetime

    base = dict(
        job_id=ident, title="Senior Engineer", description_text="Python, maintain things",
        company_name="Acme Inc", company_domain=None, country_code="US", work_mode="remote",
        remote_scope="unknown", seniority="senior", salary_min=120000.0, salary_max=160000.0,
        salary_currency="USD", salary_period="year", posted_at=datetime(2024, 5, 18),
    )
    return {**base, **changes}


def profile(**changes):
    base = dict(
        user_id=1, seniority="senior", country_code="US", work_modes=["remote"], min_salary=100000.0,
        salary_currency="usd", salary_period=None, blocked_companies=[], preferred_companies=[],
        excluded_keywords=[],
    )
    return {**base, **changes}


def score(spark, jobs, profiles, skills=None):
    j = spark.createDataFrame([tuple(x.values()) for x in jobs], JOB)
    p = spark.createDataFrame([tuple(x.values()) for x in profiles], PROFILE)
    pairs = spark.createDataFrame(
        [(b["user_id"], a["job_id"]) for a in jobs for b in profiles], "user_id long, job_id string"
    )
    s = None
    if skills:
        s = spark.createDataFrame(skills, "user_id long, skill_id string, level string")
    rows = scoring.score_given(pairs, j, p, NOW, profile_skills=s).collect()
    return {(r.user_id, r.job_id): r for r in rows}


def test_gates_fire_once_each(spark):
    cases = {
        "blocked_company": dict(blocked_companies=["acme-inc"]),
        "excluded_keyword": dict(excluded_keywords=["python"]),
        "work_mode_mismatch": dict(work_modes=["onsite"]),
        "salary_below_floor": dict(min_salary=170000.0),
        "seniority_over_band": dict(seniority="junior"),
    }
    people = [profile(user_id=i, **c) for i, c in enumerate(cases.values())]
    people.append(profile(user_id=9, excluded_keywords=["ai", " ", "c++"]))
    found = score(spark, [job(spark)], people)
    for i, code in enumerate(cases):
        row = found[(i, "j")]
        assert row.gate_reasons == [code] and row.final_score == 0 and row.rule_score > 0
    assert found[(9, "j")].gate_passed


def test_missing_data_never_gates(spark):
    bare = job(
        spark, description_text=None, country_code=None, work_mode="unknown", seniority="unknown",
        salary_min=None, salary_max=None, salary_currency=None, posted_at=None,
    )
    row = score(spark, [bare], [profile()])[(1, "j")]
    assert row.gate_passed and [b.known for b in row.breakdown] == [False] * 6
    assert [b.raw for b in row.breakdown] == [0.5, 0.5, 0.5, 0.57, 0.5, 0.5]


def test_rule_parts(spark):
    row = score(
        spark, [job(spark)], [profile(preferred_companies=["acme-inc"])], [(1, "python", "expert")]
    )[(1, "j")]
    assert [b.points for b in row.breakdown] == [35.0, 15.0, 15.0, 15.0, 5.0, 10.0]
    assert row.final_score == row.rule_score == 95.0


def test_phrase_ends(spark):
    jobs = [
        job(spark, "cpp", title="Strong C++ required"), job(spark, "go", title="GolangPro"),
        job(spark, "ml", title="machine learning"), job(spark, "net", title="a .NET shop"),
    ]
    words = [["c++"], ["golang"], ["machine learning"], [".net"], ["++"]]
    people = [profile(user_id=i, excluded_keywords=w) for i, w in enumerate(words)]
    found = score(spark, jobs, people)
    hit = {k for k, r in found.items() if r.gate_reasons == ["excluded_keyword"]}
    assert hit == {(0, "cpp"), (3, "net"), (4, "cpp")}


def test_keyword_paths_agree(spark):
    jobs = [job(spark, str(i), title=t) for i, t in enumerate(["C++ dev", "go dev", "dev ops", "x"])]
    j = spark.createDataFrame([tuple(x.values()) for x in jobs], JOB)
    k = spark.createDataFrame([("c++",), ("DEV",), ("dev ops",), ("python",), ("zz",)], "keyword string")
    few, many = (
        {r.job_id: sorted(r.keyword_hits) for r in scoring.with_keyword_hits(j, k, n).collect()}
        for n in (100, 1)
    )
    assert few == many and few["2"] == ["dev", "dev ops", "python"]


def test_eligible_pairs_whole_and_salted(spark, monkeypatch):
    rng = random.Random(3)
    levels = ["intern", "junior", "senior", "exec", "unknown"]
    modes = ["remote", "hybrid", "onsite", "unknown"]
    jobs = [job(spark, str(i), work_mode=rng.choice(modes), seniority=rng.choice(levels)) for i in range(60)]
    people = [
        profile(user_id=i, work_modes=rng.sample(modes[:3], rng.randint(0, 3)), seniority=rng.choice(levels))
        for i in range(7)
    ]
    j = scoring.prepare_jobs(spark.createDataFrame([tuple(x.values()) for x in jobs], JOB))
    p = scoring.prepare_profiles(spark.createDataFrame([tuple(x.values()) for x in people], PROFILE))
    rank = {"intern": 0, "junior": 1, "senior": 3, "exec": 8}

    def passes(a, b):
        if b["work_modes"] and a["work_mode"] != "unknown" and a["work_mode"] not in b["work_modes"]:
            return False
        x, y = rank.get(a["seniority"]), rank.get(b["seniority"])
        return x is None or y is None or x <= y + 1

    want = sorted((b["user_id"], a["job_id"]) for a in jobs for b in people if passes(a, b))
    for small in (True, False):
        monkeypatch.setattr(scoring, "small_enough", lambda *_: small)
        pairs = scoring.eligible_pairs(j, p, spread=3)
        assert sorted((r.user_id, r.job_id) for r in pairs.collect()) == want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    totals = {r.user_id: r.eligible for r in scoring.gate_totals(j, p).collect()}
    assert totals == {b["user_id"]: sum(passes(a, b) for a in jobs) for b in people}


def hot_log(spark, n=1500):
    rng = random.Random(7)
    stages = list(STAGE_MOVES)
    rows = [
        (1 if rng.random() < 0.6 else rng.randint(2, 40), i, rng.randint(0, 300), rng.choice(stages))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "application_id long, event_id long, at long, to_stage string")


def test_replay_with_a_hot_key(spark):
    rows, df = hot_log(spark)
    got = {
        r.event_id: (r.from_stage, r.accepted, r.reason)
        for r in tracker.replay_moves(df.repartition(4), ["at", "event_id"], slice_rows=7).collect()
    }
    now, want = defaultdict(lambda: "discovered"), {}
    for app, event, at, to in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        here = now[app]
        reason = None
        if to == here:
            reason = "already_in_stage"
        elif here in ("rejected", "withdrawn"):
            reason = "terminal_stage"
        elif to not in STAGE_MOVES[here]:
            reason = "illegal_move"
        else:
            now[app] = to
        want[event] = (here, reason is None, reason)
    assert got == want


def test_replay_of_a_key_of_any_length(spark):
    """200,000 moves of one key in one partition, a null key beside it."""
    log = spark.range(200_000).select(
        F.when(F.col("id") % 50 == 7, None).otherwise("a").alias("key"),
        F.col("id").alias("at"), F.pmod(F.xxhash64("id"), F.lit(3)).cast("int").alias("turn"),
    )
    # Three states on a ring: stay, go on, or go back to the first.
    turns = F.array(F.array(*map(F.lit, (0, 1, 2))), F.array(*map(F.lit, (1, 2, 0))), F.array(*map(F.lit, (0, 0, 0))))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = ordered.replay(log, ["key"], ["at"], F.get(turns, F.col("turn")), 3, 1, slice_rows=20).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    now = {"a": 1, None: 1}
    assert len(got) == 200_000
    for r in sorted(got, key=lambda r: r.at):
        assert r.state == now[r.key]
        now[r.key] = [now[r.key], (now[r.key] + 1) % 3, 0][r.turn]


def test_numbers_of_a_null_key(spark):
    log = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"), "id")
    got = ordered.with_row_number(log, ["key"], ["id"], "n").collect()
    assert sorted(r.n for r in got if r.key is None) == list(range(1, 1001)) and len(got) == 3000


def test_previous_and_numbers_with_a_hot_key(spark):
    rows, df = hot_log(spark)
    keys, order = ["application_id"], ["at", "event_id"]
    prev = {r.event_id: r.prev_event_id for r in ordered.with_previous(df, keys, order, ["event_id"]).collect()}
    nums = {r.event_id: r.row_number for r in ordered.with_row_number(df, keys, order).collect()}
    last, count = {}, Counter()
    for app, event, at, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        count[app] += 1
        assert prev[event] == last.get(app) and nums[event] == count[app]
        last[app] = event


def test_similar_titles_against_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(8, 60))) for _ in range(40)]

    def near(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice("abcdexyz") + s[i + rng.randint(0, 1):]

    titles = base + [near(s) for s in base] + [near(near(s)) for s in base] + base[:10] * 20
    rows = [
        (i, "x" if i % 40 < 25 else "y", t, 1 + i % 4, rng.random() < 0.5) for i, t in enumerate(titles)
    ]
    df = spark.createDataFrame(rows, "id long, block string, title string, sighting_count int, is_new boolean")
    new, old = df.where("is_new"), df.where("not is_new")

    def sim(a, b):
        def grams(s):
            s = f"  {s.lower()}  "
            return Counter(s[i:i + 3] for i in range(len(s) - 2))

        x, y = grams(a), grams(b)
        shared = sum((x & y).values())
        return shared / (sum(x.values()) + sum(y.values()) - shared)

    want = {}
    for i, block, title, _, fresh in rows:
        if fresh:
            options = [
                (-sim(title, t), -c, j) for j, b, t, c, f in rows
                if not f and b == block and sim(title, t) > 0.85
            ]
            if options:
                want[i] = min(options)[2]
    got = {r.id: r.match_id for r in fuzzy.best_matches(new, old).collect()}
    assert got == want and len(want) > 50


def test_merge_is_independent_of_batches(spark):
    rng = random.Random(1)
    rows = [(f"h{rng.randint(0, 5)}", i, rng.randint(0, 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "dedupe_hash string, event_id long, seen_at long")
    whole = dedupe.collapse(df, ["dedupe_hash"], ["event_id"], "seen_at", ["event_id"])
    state = None
    for part in (df.where("event_id % 3 = 0"), df.where("event_id % 3 = 1"), df.where("event_id % 3 = 2")):
        delta = dedupe.collapse(part, ["dedupe_hash"], ["event_id"], "seen_at", ["event_id"])
        state = delta if state is None else dedupe.merge_state(state, delta, ["dedupe_hash"], ["event_id"])
    cols = ["dedupe_hash", "sighting_count", "first_seen_at", "last_seen_at"]
    assert sorted(state.select(cols).collect()) == sorted(whole.select(cols).collect())


def test_scores_keep_their_explanation(spark):
    old = spark.createDataFrame([(1, "a", 10.0, "why"), (1, "b", 20.0, None)], "user_id long, job_id string, final_score double, explanation string")
    new = spark.createDataFrame([(1, "a", 30.0), (2, "c", 5.0)], "user_id long, job_id string, final_score double")
    rows = sorted(tuple(r) for r in merges.merge_scores(old, new).collect())
    assert rows == [(1, "a", 30.0, "why"), (1, "b", 20.0, None), (2, "c", 5.0, None)]


def test_nearest_whatever_the_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, vec()) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # ties go to the smaller id
    odd = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0] * 5), (204, [])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    asked = [(i, vec()) for i in range(9)] + [(9, rows[3][1]), (10, None)]
    queries = spark.createDataFrame(asked, "q long, embedding array<double>")

    def cosine(a, b):
        return min(100.0, max(0.0, 100 * float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))))

    want = []
    for q, v in asked[:-1]:
        best = sorted((-round(cosine(v, w), 6), i) for i, w in rows)[:3]
        want += [(q, i, -c, n) for n, (c, i) in enumerate(best, 1)]
    for parts, small in ((1, 64), (5, 0)):
        monkeypatch.setattr(neighbours, "BROADCAST_BLOCKS", small)
        found = neighbours.nearest(vectors.repartition(parts), queries.repartition(2), 3, "vec_id", "q").collect()
        assert sorted((r["q"], r["vec_id"], round(r["cosine"], 6), r["rank"]) for r in found) == sorted(want)
    assert neighbours.nearest(vectors.limit(0), queries, 3, "vec_id", "q").count() == 0


def test_approximate_neighbours_reach_their_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    rows = [(int(i), (centres[i % 40] + 0.8 * rng.standard_normal(32)).tolist()) for i in range(3000)]
    vectors = spark.createDataFrame(rows + [(9000, None), (9001, [0.0] * 32)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q")
    exact, near = (
        {(r["q"], r["vec_id"]) for r in f(vectors, queries, 10, "vec_id", "q").collect()}
        for f in (neighbours.nearest, neighbours.nearest_approximate)
    )
    assert len(exact) == 1500 and len(exact & near) >= 0.9 * len(exact)


def test_approximate_neighbours_are_found_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vec = lambda n: rng.standard_normal(n).tolist()
    one = vec(8)
    rows = [(i, one if i % 3 == 0 else vec(8)) for i in range(400)]  # many copies of one, ties by the smaller id
    vectors = spark.createDataFrame([*rows, *rows[:250], (500, None), (501, [0.0] * 8)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "q")
    tables, bits, radius, k = 3, 6, 1, 5
    units = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1)[:, None]
    codes = np.stack([((units @ p.T) > 0) @ (1 << np.arange(bits)) for p in neighbours._planes(tables, bits, 8)], axis=1)
    want = []
    for q in range(0, 400, 20):
        near = [i for i in range(400) if any(int(a ^ b).bit_count() <= radius for a, b in zip(codes[q], codes[i]))]
        short = units.astype("<f4").astype(float)
        best = sorted((-round(min(100, max(0, float(short[q] @ short[i]) * 100)), 6), i) for i in near)[:k]
        want += [(q, i, -c, n) for n, (c, i) in enumerate(best, 1)]
    for block, held, small in ((1_024, 256, 64), (16, 1, 64), (16, 256, 0)):
        monkeypatch.setattr(neighbours, "BROADCAST_BLOCKS", small)
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "HELD_BLOCKS", held)
        found = neighbours.nearest_approximate(vectors, queries, k, "vec_id", "q", tables=tables, bits=bits, radius=radius)
        assert "bucket" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # pairs meet as blocks
        assert sorted((r["q"], r["vec_id"], round(r["cosine"], 6), r["rank"]) for r in found.collect()) == sorted(want)


def test_search_grammar(spark):
    from rankwell.operators.search import search_records

    df = spark.createDataFrame([(1, "Senior Go engineer"), (2, "Go, the board game"), (3, "Junior baker")], "id int, t string")
    ids = lambda q: [r.id for r in search_records(df, q, ["t"]).orderBy("id").collect()]
    assert ids("go") == [1, 2] and ids("go -game") == [1] and ids('"board game"') == [2]
    assert ids("senior or baker") == [1, 3] and ids("the") == [1, 2, 3]


def test_stems_of_published_pairs():
    from rankwell.functions.stems import stem

    pairs = """consigned consign consigning consign consignment consign consistency consist consoled consol knaves
        knave knightly knight knives knive knotted knot generously generous communities communiti happy happi
        enjoying enjoy hopping hop hoping hope relational relat engineers engin nationality nation cries cri ties tie
        dying die gas gas this this agreed agre feed feed sensibility sensibl rationalize ration rolled roll
        controlling control managers manag skies sky proceed proceed by by""".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def test_search_by_stems_agrees_with_a_plain_reading(spark):
    import random
    import re

    from rankwell.functions.stems import stem
    from rankwell.operators.search import STOP_WORDS, search_stems, stem_index

    rng = random.Random(8)
    words = "managing manager managed teams team the of developers developing board boards playing plays 42".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["Go", None, "baking;bakes"])) for k in range(150)]
    rows += [(200, None, None), (201, "", ""), (202, "The THE of", None), (203, "x " * 40_000 + "teams managed", "")]
    df = spark.createDataFrame(rows, "id int, t string, u string")
    index = stem_index(df, "id", ["t", "u"]).cache()

    def stands(text, phrase):
        held = re.findall("[a-z0-9]+", text.lower())
        want = [(k, stem(w)) for k, w in enumerate(phrase.split()) if w not in STOP_WORDS]
        lead = want[0][0]
        return any(
            all(0 <= p + k - lead < len(held) and held[p + k - lead] not in STOP_WORDS and stem(held[p + k - lead]) == s for k, s in want)
            for p in range(len(held))
        )

    searches = {
        "manage": lambda x: stands(x, "manage"),
        '"team manager"': lambda x: stands(x, "team manager"),
        '"team of developers" bake': lambda x: stands(x, "team of developers") and stands(x, "bake"),
        "managers -board or 42": lambda x: (stands(x, "managers") and not stands(x, "board")) or stands(x, "42"),
        "-playing": lambda x: not stands(x, "playing"),
        '-"boards play" or going': lambda x: not stands(x, "boards play") or stands(x, "going"),
        "the of": lambda x: True,
    }
    for search, holds in searches.items():
        got = sorted(r.id for r in search_stems(df, index, search, "id").collect())
        assert got == [k for k, t, u in rows if holds(f"{t or ''} {u or ''}")], search
    assert search_stems(df.where("id < 0"), stem_index(df.where("id < 0"), "id", ["t"]), "team", "id").count() == 0


def test_insert_absent_keeps_every_row_without_a_second_key(spark):
    from rankwell.operators.merges import insert_absent

    table = spark.createDataFrame([(1, "a@x")], "id int, email string")
    rows = spark.createDataFrame([(2, None), (3, None), (4, "a@x"), (5, "b@x"), (6, "b@x")], "id int, email string")
    new = insert_absent(table, rows, ["id"], ["email"], other="email")
    assert sorted((r.id, r.email) for r in new.collect()) == [(2, None), (3, None), (5, "b@x")]


def test_a_cluster_session_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest

    from rankwell.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(ValueError):
        shared_dir(remote)


def test_stem_index_of_repeated_keys_without_a_shuffle(spark):
    """Rows that repeat a key are found together, and no posting leaves the task that reads its text."""
    from rankwell.operators.search import search_stems, stem_index

    rows = [(1, "Senior ENGINEERS, of teams"), (1, "London"), (2, "engineer"), (None, "senior"), (3, None), (4, "é-senior\u212a \n")]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    index = stem_index(df, "id", ["t"])
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition above
    held = sorted(((r.id or 0, r.stem, r.places) for r in index.collect()))
    assert held == [
        (0, "senior", [0]), (1, "engin", [1]), (1, "london", [0]), (1, "senior", [0]), (1, "team", [3]), (2, "engin", [0]),
        (4, "seniork", [0]),
    ]
    found = lambda text: sorted(r.id or 0 for r in search_stems(df, index, text, "id").collect())
    assert found("senior london") == [1, 1] and found("engineering") == [1, 1, 2] and found("-london") == [2, 3, 4]

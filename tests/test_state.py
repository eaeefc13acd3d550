"""Applications over tables that hold rows, runs over bad records, catalogue, reports of spans."""

from datetime import datetime

from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankwell.operators import dedupe, merges, reports, scoring, tracker

JOBS = "job_id string, title string, company_name string"
REQUESTS = "user_id int, job_id string, applied_at string, request_id int, next_action_at string, notes string"
HISTORY = "user_id int, job_id string, from_stage string, to_stage string"


def test_apply_to_a_table_that_holds_rows(spark):
    jobs = spark.createDataFrame([("a", "Engineer", "X"), ("b", "Analyst", "Y")], JOBS)
    held = spark.createDataFrame([(1, "a", "day 1", 9, None, "old")], REQUESTS)
    sent = spark.createDataFrame(
        [(1, "a", "day 2", 1, None, "again"), (1, "b", "day 3", 2, "day 9", "first"),
         (1, "b", "day 4", 3, None, "later"), (2, "a", "day 3", 4, None, None), (2, "gone", "day 3", 5, None, None)],
        REQUESTS,
    )
    new = tracker.apply_once(held, sent, jobs)
    got = {(r.user_id, r.job_id): (r.request_id, r.next_action_at, r.notes, r.job_snapshot.title) for r in new.collect()}
    assert got == {(1, "b"): (2, "day 9", "first", "Analyst"), (2, "a"): (4, None, None, "Engineer")}

    none = spark.createDataFrame([], HISTORY)
    moved = spark.createDataFrame([(1, "a", "saved", "applied")], HISTORY)
    both = held.unionByName(new.select(*held.columns))
    rows = tracker.first_history(both, moved)
    assert {(r.user_id, r.job_id, r.from_stage, r.note) for r in rows.collect()} == {
        (1, "a", None, "old"), (1, "b", None, "first"), (2, "a", None, None),
    }
    assert tracker.first_history(both, rows).count() == 0
    assert tracker.first_history(held.limit(0), none).count() == 0


def test_moves_change_the_application(spark):
    table = spark.createDataFrame(
        [(1, "saved", "t0", "soon"), (2, "applied", "t0", "soon"), (3, "saved", "t0", "soon")],
        "application_id int, stage string, updated_at string, next_action_at string",
    )
    moves = spark.createDataFrame(
        [(1, "applied", "t1", 1, True), (1, "screening", "t2", 2, True), (2, "screening", "t1", 3, True),
         (3, "offer", "t1", 4, False)],
        "application_id int, to_stage string, acted_at string, event_id int, accepted boolean",
    )
    got = {tuple(r) for r in tracker.apply_moves(table, moves).collect()}
    assert got == {(1, "screening", "t2", None), (2, "screening", "t1", "soon"), (3, "saved", "t0", "soon")}


def test_newest_first_of_a_long_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).alias("key"), (F.col("id") % 700).alias("at"), "id")
    got = tracker.newest_first(rows, ["key"], ["at", "id"]).collect()
    want = {}
    for key in (None, 0, 1, 2):
        mine = sorted((r for r in got if r.key == key), key=lambda r: (r.at, r.id), reverse=True)
        want |= {r.id: i for i, r in enumerate(mine, 1)}
    assert {r.id: r.position for r in got} == want and len(got) == 5000


def test_catalogue_and_versions(spark):
    skills = spark.createDataFrame([("B", "b", ["bee"]), ("A", "a", None)], "name string, slug string, aliases array<string>")
    chosen = spark.createDataFrame([(1, "a", None), (1, "zzz", "expert")], "user_id int, skill_id string, level string")
    profiles = spark.createDataFrame([(1, "mid"), (2, None)], "user_id int, seniority string")
    got = [tuple(r) for r in tracker.profile_catalogue(profiles, skills, chosen).orderBy("user_id", "name").collect()]
    assert got == [
        (1, "mid", "A", "a", [], "proficient", True), (1, "mid", "B", "b", ["bee"], None, False),
        (2, None, "A", "a", [], None, False), (2, None, "B", "b", ["bee"], None, False),
    ]
    versions = spark.createDataFrame(
        [(1, "v1", "1/x/old.pdf", "t1"), (1, "v2", "new.pdf", "t2"), (3, "v3", "a/b.pdf", "t1")],
        "user_id int, resume_version_id string, file_path string, created_at string",
    )
    listed = tracker.version_list(profiles, versions).select("user_id", "name", "position").collect()
    assert {tuple(r) for r in listed} == {(1, "new.pdf", 1), (1, "old.pdf", 2), (2, None, None)}


def test_bad_records_cost_only_their_own_pairs(spark):
    columns = (
        "job_id string, title string, description_text string, company_name string, company_domain string, country_code string, "
        "work_mode string, remote_scope string, seniority string, salary_min string, salary_max string, "
        "salary_currency string, salary_period string, posted_at string"
    )
    record = lambda job, pay, at: (job, "Engineer", "Python", "X", None, "US", "remote", "global", "mid", pay, None, "USD", "year", at)
    records = spark.createDataFrame(
        [record("good", "5000", "1995-06-01"), record("pay", "5k", "1995-06-01"), record("both", "x", "1995-13-01"),
         record("empty", None, None), record("low", "1", "1995-06-01")],
        columns,
    )
    profiles = spark.createDataFrame(
        [(u, "mid", "US", ["remote"], 1000.0, "USD", "year", [], [], []) for u in (1, 2)],
        "user_id int, seniority string, country_code string, work_modes array<string>, min_salary double, salary_currency string, "
        "salary_period string, blocked_companies array<string>, preferred_companies array<string>, excluded_keywords array<string>",
    )
    pairs = spark.createDataFrame(
        [(1, j) for j in ("good", "pay", "both", "empty", "low", "unknown", "good")] + [(2, "pay"), (3, "pay")],
        "user_id int, job_id string",
    )
    kinds = {"salary_min": "double", "salary_max": "double", "posted_at": "timestamp"}
    rows = scoring.score_checked(pairs, records, kinds, profiles, "1995-06-30 00:00:00")
    metrics = Observation("run")
    got = {(r.user_id, r.job_id): (r.faults, r.final_score is None) for r in rows.observe(metrics, *scoring.run_counters()).collect()}
    assert got == {
        (1, "good"): (None, False), (1, "empty"): (None, False), (1, "low"): (None, False),
        (1, "pay"): (["salary_min"], True), (1, "both"): (["salary_min", "posted_at"], True), (2, "pay"): (["salary_min"], True),
    }
    assert metrics.get == {"scored": 3, "failed": 3, "gated": 1}


def test_sightings_merge_on_record_and_address(spark):
    shape = "job_id string, source_url string, sighting_count bigint, first_seen_at string, last_seen_at string, source_id int"
    old = spark.createDataFrame([("a", "u1", 2, "t1", "t2", 7), ("a", "u2", 1, "t1", "t1", 8)], shape)
    new = spark.createDataFrame([("a", "u1", 3, "t3", "t4", 9), ("b", "u1", 1, "t3", "t3", 9)], shape)
    got = {tuple(r) for r in dedupe.merge_state(old, new, ["job_id", "source_url"], ["source_id"]).collect()}
    assert got == {("a", "u1", 5, "t1", "t4", 7), ("a", "u2", 1, "t1", "t1", 8), ("b", "u1", 1, "t3", "t3", 9)}


def test_days_to_first(spark):
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    history = spark.createDataFrame(
        [(1, "applied", at(1)), (1, "interview", at(5, 23)), (1, "interview", at(20)), (2, "applied", at(2)),
         (3, "applied", at(3)), (3, "interview", at(10)), (4, "interview", at(3)), (5, "applied", at(9)), (5, "interview", at(8))],
        "application_id int, to_stage string, acted_at timestamp",
    )
    got = {r.week.day: (r.applications, r.reached, r.median_days) for r in reports.days_to_first(history, "applied", "interview").collect()}
    assert got == {1: (3, 2, 5.5), 8: (1, 0, None)}


def test_completed_work_is_not_done_again(spark):
    state = spark.createDataFrame(
        [(1, "completed", 1, None), (2, "failed", 1, "old")], "doc_id int, status string, attempts int, error string"
    )
    queue = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id int")
    assert sorted(r.doc_id for r in merges.pending(queue, state, "doc_id").collect()) == [2, 3, 4]
    outcomes = spark.createDataFrame([(1, "late"), (2, None), (3, "bad")], "doc_id int, error string")
    got = {tuple(r) for r in merges.after_processing(state, outcomes, "doc_id").collect()}
    assert got == {(1, "completed", 1, None), (2, "completed", 2, None), (3, "failed", 1, "bad")}
    none = merges.after_processing(state, outcomes.limit(0), "doc_id")
    assert {tuple(r) for r in none.collect()} == {(1, "completed", 1, None), (2, "failed", 1, "old")}

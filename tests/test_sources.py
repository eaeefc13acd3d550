import datetime as dt
import json

from pyspark.sql import functions as F

from rankwell.sources import config, keyed, payloads
from rankwell.sources.tables import read_applications_csv
from rankwell.streaming import ingest

JOB_URL = "https://boards.example.com/jobs/1"
PAYLOADS = [
    ("api_greenhouse", "acme", {"company": {"name": "Acme Corp"}, "extra": 1, "jobs": [
        {"id": 40281, "title": "Senior Engineer", "absolute_url": JOB_URL, "content": "<p>x<b>y</b></p>",
         "updated_at": "2026-09-28T10:15:00Z"}]}),
    ("api_greenhouse", "broken", {"company": None}),
    ("api_greenhouse", "half", {"jobs": [{"id": 1, "title": "A", "absolute_url": JOB_URL}, {"id": 2}]}),
    ("api_lever", "acme", [
        {"id": "9f", "text": "Staff Engineer", "hostedUrl": JOB_URL, "createdAt": 1759046400000,
         "categories": {"location": "Bengaluru, India"}}]),
    ("api_lever", "none", []),
    ("api_ashby", "org", {"jobs": [
        {"id": "a", "title": "QA", "jobUrl": JOB_URL, "isRemote": False, "location": {"location": "London, UK"}},
        {"id": "b", "title": "PE", "jobUrl": JOB_URL, "isRemote": True,
         "compensation": {"compensationTierSummary": "$120k – $160k"}}]}),
    ("api_arbeitnow", "all", {"data": [
        {"slug": "s1", "company_name": "N", "title": "B", "remote": True, "url": JOB_URL, "created_at": 1759046400},
        {"slug": "s2", "company_name": "N", "title": "B", "is_remote": False, "url": JOB_URL,
         "created_at": 1756473600000}]}),
    ("api_usajobs", "all", {"SearchResult": {"SearchResultItems": [{"MatchedObjectId": "D1",
        "MatchedObjectDescriptor": {"PositionTitle": "T", "PositionLocationDisplay": ["Washington, DC", "Remote"],
            "PositionRemuneration": [{"Value": "$150,000.00 Per Year", "RateIntervalCode": "Year"}]}}]}}),
    ("api_adzuna", "gb", {"results": [
        {"id": "1", "redirect_url": JOB_URL, "title": "ML", "salary_min": 85000, "salary_currency": "gbp"},
        {"id": "2", "title": "No link"}]}),
    ("firecrawl_scrape", "site", {"success": True, "data": {"json": {"jobs": [
        {"title": "R", "companyName": "H", "sourceUrl": JOB_URL, "workMode": "remote"},
        {"title": "Broken", "companyName": "H"}]}}}),
    ("firecrawl_scrape", "bad", {"success": False}),
    ("firecrawl_search", "q", {"success": True, "data": [
        {"url": JOB_URL, "description": "d"}, {"url": "http://a.example.com"}, {"url": "https://127.0.0.1/"}]}),
    ("api_remotive", "junk", "not json"),
]


def frame(spark):
    rows = [(v if isinstance(v, str) else json.dumps(v), k, t) for k, t, v in PAYLOADS]
    return spark.createDataFrame(rows, "value string, kind string, token string")


def test_scan_and_quarantine(spark):
    raw = payloads.scan(frame(spark)).collect()
    by = {(r.source_kind, r.external_id): r for r in raw}
    assert len(raw) == len(by) == 10
    assert by[("api_greenhouse", "40281")].company_name == "Acme Corp"
    assert by[("api_lever", "9f")].apply_url == JOB_URL and by[("api_lever", "9f")].company_name == "acme"
    assert by[("api_ashby", "a")].work_mode is None and by[("api_ashby", "b")].work_mode == "remote"
    assert by[("api_arbeitnow", "s1")].posted_at.year == by[("api_arbeitnow", "s2")].posted_at.year == 2025
    gov = by[("api_usajobs", "D1")]
    assert gov.location_raw == "Washington, DC; Remote" and gov.salary_period == "year"
    assert gov.source_url.endswith("/job/D1") and gov.company_name == "USAJOBS"
    assert by[("api_adzuna", "1")].salary_currency == "GBP"
    assert by[("firecrawl_search", JOB_URL)].title == JOB_URL
    bad = {(r.kind, r.token): r.refused for r in payloads.quarantine(frame(spark)).collect()}
    assert bad == {
        ("api_greenhouse", "broken"): "no_items", ("api_greenhouse", "half"): "bad_item",
        ("firecrawl_scrape", "bad"): "upstream_failure", ("firecrawl_scrape", "site"): "bad_item",
        ("api_remotive", "junk"): "not_json",
    }


def test_normalise(spark):
    rows = {r.external_id: r for r in payloads.normalise(payloads.scan(frame(spark))).collect()}
    one = rows["40281"]
    assert (one.title_norm, one.seniority, one.description_html) == ("seniorengineer", "senior", "<p>xy</p>")
    assert (rows["9f"].city, rows["9f"].country_code) == ("Bengaluru", "IN")
    assert rows["D1"].salary_min == 150000 and rows["1"].salary_min is None
    kept = payloads.normalise(payloads.scan(frame(spark)), prefer_structured=True)
    assert kept.where("external_id = '1'").first().salary_min == 85000
    assert all(len(r.dedupe_hash) == 64 for r in rows.values())


def test_site_links(spark):
    value = json.dumps({"success": True, "links": ["https://a.example.com/x", "http://b.example.com"]})
    df = spark.createDataFrame([(value, "firecrawl_map", "s")], "value string, kind string, token string")
    assert [r.link for r in payloads.site_links(df).collect()] == ["https://a.example.com/x"]


def test_source_settings(spark):
    seeds = config.seed_sources(spark)
    assert seeds.count() == 9 and config.seed_sources(spark, seeds.limit(4)).count() == 9
    assert config.seed_skills(spark).count() == 10
    rows = [("g", "api_greenhouse", '{"board": "b1", "boards": ["x"]}'), ("a", "api_adzuna", "{}"),
            ("f", "firecrawl_search", '{"queries": ["q1", "q2"]}')]
    got = config.targets(spark.createDataFrame(rows, "name string, kind string, config string"))
    found = sorted((r.name, r.token) for r in got.collect())
    assert found == [("a", c) for c in ("au", "ca", "de", "gb", "us")] + [("f", "q1"), ("f", "q2"), ("g", "b1")]
    ready = seeds.withColumn("id", F.col("name")).withColumn("next_run_at", F.lit(None).cast("timestamp"))
    ready = ready.withColumn("consecutive_failures", F.lit(None).cast("int"))
    assert config.enabled_sources(ready).count() == 9 and "config" not in config.enabled_sources(ready).columns


def test_keyed_table_reads_and_writes_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    add = lambda state, delta: (delta if state is None else state.unionByName(delta)).groupBy("k").agg(F.sum("n").alias("n"))
    assert keyed.read_keyed(spark, path) is None and keyed.rows_of(spark, path, spark.range(1), ["id"]) is None
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))
    keyed.merge_batch(path, rows, ["k"], 0, add, buckets=8)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    keyed.merge_batch(path, rows.where("k = 7"), ["k"], 1, add, buckets=8)
    keyed.merge_batch(path, rows.where("k = 7"), ["k"], 1, add, buckets=8)  # sent again: nothing happens
    after = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert len({p.parent for p in files.items() - after.items() for p in [p[0]]}) == 1
    found = {r["k"]: r["n"] for r in keyed.read_keyed(spark, path).collect()}
    assert found == {k: 2 if k == 7 else 1 for k in range(200)}
    # A batch that was lost half way: some of its buckets are written, the others are not.
    keyed.merge_batch(path, rows.where(keyed.bucket_of(["k"], 8) < 4), ["k"], 2, add, buckets=8)
    keyed.merge_batch(path, rows, ["k"], 2, add, buckets=8)
    found = {r["k"]: r["n"] for r in keyed.read_keyed(spark, path).collect()}
    assert found == {k: 3 if k == 7 else 2 for k in range(200)}
    # A bucket whose rows all go is empty afterwards.
    keyed.merge_batch(path, rows, ["k"], 3, lambda state, delta: state.join(delta, "k", "left_anti"), buckets=8)
    assert keyed.read_keyed(spark, path).count() == 0
    keyed.merge_batch(path, rows.limit(0), ["k"], 4, add, buckets=8)
    assert keyed.rows_of(spark, path, rows, ["k"], buckets=8).count() == 0


def test_open_sightings_are_bounded_and_totals_whole(spark, tmp_path):
    opened, closed = str(tmp_path / "o"), str(tmp_path / "c")
    handle = ingest.merge_open_sightings(opened, closed, "h", "seen_at", "2 days")
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    batches = [[(f"h{10 * b + k}", day(3 * b)) for k in range(10)] + [("kept", day(3 * b))] for b in range(5)]
    batches.append([("h0", day(0.5)), ("h3", day(13)), (None, day(13))])  # late by twelve days; one that comes back
    batches.append([("last", day(40))])
    want = {}
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "h string, seen_at timestamp")
        handle(batch, number)
        handle(batch, number)
        for h, at in rows:
            n, first, last = want.get(h, (0, at, at))
            want[h] = (n + 1, min(first, at), max(last, at))
        newest = max(last for _, _, last in want.values())
        recent = {h for h, at in rows if newest - at <= dt.timedelta(days=2)}
        assert keyed.read_keyed(spark, opened).count() <= len(recent) + 11
    assert [r["h"] for r in keyed.read_keyed(spark, opened).collect()] == ["last"] and len(want) > 50
    total = ingest.all_sightings(spark, opened, closed, "h").collect()
    assert {r["h"]: (r["sighting_count"], r["first_seen_at"], r["last_seen_at"]) for r in total} == want
    assert ingest.all_sightings(spark, str(tmp_path / "x"), str(tmp_path / "y"), "h") is None


def test_csv_import(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'company,title,url,stage,date\n"Acme, Inc",Dev,https://x,Applied,2024-01-02\n,Dev,u,applied,2024-01-02\n'
        "A,Dev,u,nope,2024-01-02\nA,Dev,u,applied,soon\nA,,u,applied,2024-01-02\n"
    )
    good, bad = read_applications_csv(spark, str(path))
    assert [r.job_snapshot.company_name for r in good.collect()] == ["Acme, Inc"]
    assert sorted(r.reason for r in bad.collect()) == ["bad_date", "company_missing", "title_missing", "unknown_stage"]


def test_stream_replays_no_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("h", 5, 1), ("h", 3, 2)], "dedupe_hash string, seen_at long, event_id long")
    merge = ingest.merge_sightings(path, "dedupe_hash", "seen_at", ["event_id"], ["event_id"])
    merge(rows, 0)
    merge(rows, 0)
    late = spark.createDataFrame([("h", 1, 9)], "dedupe_hash string, seen_at long, event_id long")
    merge(late, 1)
    row = keyed.read_keyed(spark, path).first()
    assert (row.sighting_count, row.first_seen_at, row.last_seen_at, row.event_id) == (3, 1, 5, 2)

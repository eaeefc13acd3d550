"""Registered queries: names, agreement with their SQL on the smallest data, and plan shape."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracle import rows_of  # noqa: E402
from rankwell.plans.adapters import TABLES  # noqa: E402
from rankwell.plans.catalogue import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SAMPLE = [
    "exact_dedupe", "parse_salary", "list_clean", "rule_score", "ranked_feed", "stage_replay",
    "run_stats", "fuzzy_best", "payload_scan", "stream_first_seen", "digest", "vector_topk",
    "feed_search_stems", "html_text", "moved_applications", "resume_profiles", "resume_seeds", "resume_status",
    "profile_catalogue", "history_newest_first", "address_sightings",
]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 90


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    mine, other = rows_of(QUERIES[name](spark, SF).toPandas()), rows_of(db.execute(ORACLES[name]).fetchdf())
    assert mine == other


@pytest.mark.parametrize("name", ["rule_score", "cohort_rescore", "search_preview", "cluster_dismiss"])
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_page_is_limited_before_the_shuffle(spark):
    plan = QUERIES["feed_page2"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scan_reads_only_what_is_used(spark):
    plan = QUERIES["funnel"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "value" not in schema and "event_type" in schema

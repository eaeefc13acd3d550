"""Times the headline queries on $BENCH_SF_DIR and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankwell.plans.catalogue import QUERIES  # noqa: E402
from rankwell.session import build_session  # noqa: E402

HEADLINE = [
    "exact_dedupe", "source_sightings", "merge_resightings", "document_exact_dups", "parse_salary",
    "skill_tags_of_documents", "html_sanitise", "url_guard", "redact", "gate_reasons", "rule_score",
    "cohort_rescore", "ranked_feed", "feed_search", "fuzzy_best", "vector_topk", "stage_replay",
    "run_stats", "failure_streak", "sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["funnel"](spark, sf_dir).collect()  # start-up is not part of any query
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Headline benchmark: prints one JSON line.

Runs the queries below at $BENCH_SF_DIR on local[$BENCH_CPUS] and reports the median of $BENCH_RUNS runs each,
after one warm-up of the session. Every result is written to the no-op sink, so all rows are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from askloom.plans import registry  # noqa: E402
from askloom.session import local_session, scope  # noqa: E402

HEADLINE = [
    "flagship",
    "upsert_by_url",
    "html_to_text",
    "normalize_text",
    "dedupe_lines",
    "canonical_url",
    "split_qa_lines",
    "labelled_divs",
    "heading_walk",
    "bold_labels",
    "marker_posts",
    "readable_text",
    "extract_links",
    "stale_cutoff",
    "robots_filter",
    "exact_dup_groups",
    "browse_page",
    "substring_search",
    "token_search",
    "batch_search",
    "corpus_stats",
    "related_top",
    "apply_status_events",
    "reviewer_stats",
    "monthly_payment_all",
    "user_status",
    "trial_replay",
    "grant_week",
    "donation_stats",
    "cache_upsert",
    "recent_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session(cpus, "askloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["canonical_url"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            with scope(spark):
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()

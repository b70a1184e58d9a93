"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query runs
once to warm up and is then timed while its rows go to the ``noop`` sink, so
nothing is pruned and nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postmill.bindings import load  # noqa: E402
from postmill.session import local_session  # noqa: E402

HEADLINE = (
    "recommend", "knn_topk", "skill_feedback", "category_feedback", "excluded_companies",
    "html_to_text", "page_text_stats", "embedding_text", "theta_join_single_words",
    "upsert_postings", "missed_run_streak", "cleanup_candidates", "status_transitions",
    "partial_update", "run_log", "normalize_source", "parse_verdict", "latency_p95",
    "queue_depth", "stream_upsert",
)


def run(spark, fn, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times = {}
    for name in HEADLINE:
        run(spark, queries[name], sf_dir)
        times[name] = round(min(run(spark, queries[name], sf_dir) for _ in range(2)), 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

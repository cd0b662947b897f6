"""Headline queries at one scale; prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the cores. Every query runs
once to warm up (reported as ``cold``) and once more for its time.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitescope.checks.queries import QUERIES  # noqa: E402
from sitescope.session import local_session  # noqa: E402

HEADLINE = (
    "search_page",
    "search_text",
    "facets_bundle",
    "search_total_filtered",
    "page_capture",
    "extract_links",
    "link_frontier",
    "robots_gate",
    "polite_schedule",
    "detect_technologies",
    "detect_marketing",
    "seo_signals",
    "seo_scores",
    "seo_profiles",
    "search_projection",
    "company_detail",
    "request_crawls",
    "job_detail",
    "job_fold",
    "upsert_latest",
    "replace_for_company",
    "integrity_summary",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session("sitescope-bench", cpus)
    cold = {name: run(spark, sf_dir, name) for name in HEADLINE}
    warm = {name: run(spark, sf_dir, name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, warm total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from annolytics.session import local_session
from annolytics.workloads.queries import QUERIES

HEADLINE = [
    "annotation_counts_by_split_class",
    "validation_issue_counts",
    "duplicate_members",
    "remap_labels",
    "removed_files",
    "split_assignment",
    "split_refined",
    "freeze_summary",
    "dataset_digest",
    "iou_candidates",
    "greedy_matches",
    "error_categories",
    "average_precision",
    "latency_summary",
    "run_summary",
    "comparison_headline",
    "session_summary",
    "session_summary_stream",
    "violation_frames",
    "preview_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session("bench", cpus=int(os.environ.get("BENCH_CPUS", "8")), memory="16g")
    spark.range(1000).repartition(8).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR   folder with the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default: all)
BENCH_REPEATS  timed runs per query after one warm-up; the median counts (default 1)
BENCH_QUERIES  comma-separated names instead of the headline set
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from quirefold.plans.registry import QUERIES
from quirefold.session import local_session

HEADLINE = [
    "nms", "postprocess", "detection_agreement", "precision_recall", "coco_match", "class_ap", "shadow_diff", "gt_box_issues", "batch_rollup",
    "batch_timings", "item_state_fold", "micro_batches", "lease_sweep", "trial_summary", "bootstrap_ci", "gate_verdicts", "register_pages",
    "fan_out_items", "annotation_hash", "pinning_audit", "evaluation_row", "constraint_audit", "item_view", "gt_ink_issues", "bench_samples",
]


def run(fn, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS") or os.cpu_count() or 4)
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session("quirefold-bench", cores=cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("FATAL")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        fn = QUERIES[name]
        run(fn, spark, sf_dir)
        times[name] = round(statistics.median(run(fn, spark, sf_dir) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

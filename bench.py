"""Time the headline queries: one JSON line with seconds per query (median of three, after a warm-up)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from cohortloom import catalog  # noqa: E402

HEADLINE = [
    "flagship_cohort",
    "first_copies",
    "join_coverage",
    "dataset_overview",
    "inclusion_mask",
    "entity_names",
    "participants_harmonized",
    "orders_with_customer",
    "wide_volumes_with_orders",
    "volume_ratios",
    "complete_regions",
    "price_profile",
    "median_per_user",
    "box_statistics",
    "grouped_histogram",
    "value_curves",
    "event_positions",
    "contiguous_folds",
    "grouped_fold_loads",
    "metrics_by_group",
    "standardized_values",
    "out_of_fold_predictions",
    "batch_scores",
    "scan_status",
    "batch_work_plan",
    "evaluation_labels",
    "image_headers",
    "streamed_index",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i or not runs:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

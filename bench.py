"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) on ``local[BENCH_CPUS]``.
Each query runs once to warm up and is then timed over ``BENCH_RUNS`` runs; the
best one counts. Results are written to Spark's ``noop`` sink, so whole results
are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallymark.catalog.all import QUERIES

HEADLINE = [
    "rec_summary",
    "rec_field_stats",
    "rec_statistics",
    "rec_summary_lineitem",
    "rec_field_stats_lineitem",
    "rec_classified",
    "rec_breaks",
    "rec_duplicate_keys",
    "rec_hot_key_summary",
    "key_alternatives",
    "change_audit",
    "change_counts",
    "report_different",
    "rec_adjustments",
    "filter_chain",
    "pivot_sum",
    "pivot_last",
    "lookup_composite",
    "pivot_lookup",
    "profile",
    "batch_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        # recording the Python call site of every column costs more than planning small queries
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt > 0:
                best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_QUERIES (comma list
or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pitsignal.catalog import QUERIES  # noqa: E402

# Each query is timed so often; the median counts.
RUNS = 3

HEADLINE = [
    "feature_buckets", "feature_dataset", "speed_bands", "optimal_freq", "hour_metric_crosstab",
    "monotonic_violations", "rolling_mean_chunked", "clean_sensor", "clean_time_model",
    "clean_either_date", "temporal_clean", "metric_gaps", "daily_density_stats", "dup_rows",
    "completeness", "null_patterns", "raw_vs_clean", "constraint_violations", "daily_counts",
    "minute_totals", "busiest_day", "describe_numeric", "describe_categorical", "corr_matrix",
    "median_series", "histogram30", "kde_by_metric", "box_stats", "iqr_outliers", "ols_trend",
    "hash_sample", "fuel_dispatch", "fuel_overlay", "pair_stack", "row_numbers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    names = sorted(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false").config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    # Start the engine and read the table footers before the clock runs.
    for table in ("events", "lineitem", "orders", "customer"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").groupBy().count().collect()
    QUERIES["describe_grouped"].run(spark, sf_dir).collect()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            spark.catalog.clearCache()
        seconds[name] = round(median(taken), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and, for a shorter
run, BENCH_QUERIES (comma separated) are read from the environment.  Every query runs
in full into the no-op sink, inputs derived from the tables each time.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallygrid.plans import catalog

HEADLINE = [
    "normalized_cells",
    "failed_checks",
    "aligned_grid_hybrid",
    "merged_cell_texts",
    "detection_scores_at_thresholds",
    "recognition_by_source",
    "label_report",
    "lookup_answers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallygrid-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    times = {}
    for name in names:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    orders = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey").distinct().count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "tables": orders,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

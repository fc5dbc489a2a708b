"""Timings of the headline queries; prints one JSON line.

BENCH_SF_DIR   tables to read (default the sf0.1 folder)
BENCH_CPUS     local threads (default 8)
BENCH_RUNS     timed runs per query after one warm-up; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from emporia.plans import QUERIES
from emporia.session import build_session
from emporia.sources.store import run_folder

HEADLINES = [
    "clean_purchases",
    "top_products_by_revenue",
    "revenue_by_month",
    "kpi_geo",
    "top_products_per_delegation",
    "dedup_purchases",
    "kpi_product",
    "customer_features",
    "monthly_series",
    "pair_metrics",
    "placement",
    "layout",
    "association_rules",
    "forecast_seasonal",
    "analyze_pairs",
    "match_product_name",
    "answer_pairs",
    "rank_regions",
    "route_questions",
    "segment_customers",
]


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        f"local[{cpus}]", "emporia-bench", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in wanted:

        def run(name=name):
            with run_folder(spark):
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(statistics.median(timed(run) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()

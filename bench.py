"""Wall time of headline queries: prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma separated) a subset.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from tablewright.catalog import QUERIES
from tablewright.runtime import local_session

HEADLINE = [
    "profile_dataset",
    "leakage_report",
    "describe_numeric",
    "kde_grid",
    "joined_group_stats",
    "multi_hot",
    "nearest_place",
    "standard_scale",
    "preprocess",
    "stratified_split",
    "regression_metrics",
    "roc_auc",
    "regression_cv",
    "ridge_fit",
    "rf_fit",
    "extra_trees_fit",
    "tokenize",
    "bm25_search",
    "vector_topk",
    "hybrid_search",
    "lexical_search",
    "notebook_chunks",
    "run_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", str(os.cpu_count())), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors before the clock runs
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

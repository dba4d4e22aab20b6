"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the number of
cores. Each query writes to the no-op sink, so all of its rows are produced and
none are collected; the best of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from colmap.session import configure  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# query -> table whose rows it goes through
HEADLINE = {
    "standardize_single": "labels",
    "standardize_pair": "conversations",
    "standardize_rows": "documents",
    "label_decode": "labels",
    "keyword_match": "documents",
    "embedding_match": "embeddings",
    "prompt_inputs": "documents",
    "response_extract": "documents",
    "response_lenient": "documents",
    "taskdata_expand": "labels",
    "value_overlap_10": "documents",
    "value_overlap_full": "documents",
    "value_overlap_table": "labels",
    "value_overlap_lineitem": "lineitem",
    "catalog_cells": "lineitem",
    "presence_score": "events",
    "jaccard_scores": "documents",
    "spec_scores": "documents",
    "infer_stub": "documents",
    "score_table": "documents",
    "card_discovery": "part",
    "stream_standardize": "events",
}
RUNS = 2


def main() -> None:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sizes = {
        t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(HEADLINE.values())
    }
    seconds, rate = {}, {}
    for name, source in HEADLINE.items():
        best = None
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
        rate[name] = round(sizes[source] / best)
    spark.stop()
    print(json.dumps({
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": rate,
        "sf": os.path.basename(SF_DIR.rstrip("/")),
        "cpus": int(CPUS),
    }))


if __name__ == "__main__":
    main()

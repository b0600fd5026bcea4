"""Time the headline queries; print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Every query runs in full into a
sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from casebook.plans.catalog import QUERIES
from casebook.sources.staging import release

HEADLINE = [
    "column_overview", "duplicate_count", "csv_roundtrip", "date_parts", "label_regroup",
    "monthly_volume", "untimely_rate", "top_issue_drilldown", "state_counts",
    "word_stats", "amount_quantile", "export_clean", "word_histogram", "confidence_density",
    "chi_square_yates", "cramers_matrix", "normalise_text", "tokens", "lemmas", "clean_text",
    "vocab_stats", "stratified_split", "stratified_folds", "augmented", "ngrams", "vocabulary",
    "weights", "unseen_weights", "class_weights", "class_report", "threshold_sweep",
    "feature_vectors", "level1_lr",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("casebook-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start-up is not a query
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()

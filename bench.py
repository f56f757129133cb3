"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from feedgate.plans import inputs
from feedgate.plans.catalog import QUERIES
from feedgate.sources.scratch import new_path

TABLES = ("customer", "documents", "embeddings", "events", "lineitem", "orders", "pages", "part", "supplier")

HEADLINE = [
    "release_projection",
    "dropped_report",
    "nested_release",
    "content_fingerprint",
    "exact_numbers",
    "outcome_detection",
    "sequence_assignment",
    "apply_batch",
    "repeated_lines",
    "idempotent_upsert",
    "streaming_apply",
    "source_attribution",
    "declared_filter",
    "change_feed",
    "byte_budget_pages",
    "page_walk",
    "collection_checksum",
    "chained_checksum",
    "manifest",
    "drift_report",
    "replica_fold",
    "dropped_totals",
]


def split_tables(spark: SparkSession, folder: str, files: int) -> str:
    """The given tables once more, as several files each: a given file is one row group, which one task reads."""
    path = new_path(spark, "tables")
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").repartition(files).write.parquet(f"{path}/{name}.parquet")
    return path


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("feedgate-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    with contextlib.redirect_stdout(sys.stderr):
        # Written before the clock starts: the tables as several files, and the record tables that reads start from.
        given, folder = folder, split_tables(spark, folder, int(cpus))
        for name in ("part", "event", "order", "line", "document"):
            inputs.records(spark, folder, name).count()
        times = {}
        for name in HEADLINE:
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(given.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

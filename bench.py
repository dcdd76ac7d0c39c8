"""Times the headline queries; prints one JSON line.

Each query runs once on the smallest data, so that class loading is not counted, and then
three times on ``$BENCH_SF_DIR``; the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlift import catalog
from feedlift.catalog.feed import filtered, table
from feedlift.catalog.warehouse import run_batched
from feedlift.config import FeedConfig
from feedlift.operators.generation import FunctionCompleter
from feedlift.operators.joins import join_page_texts
from feedlift.operators.numbering import number_rows, pack_chunks
from feedlift.plans.batched import BatchOptions
from feedlift.plans.review_feed import review_feed

ROUND = "batched_round"

HEADLINE = [
    "filter_mid_clicks",
    "sample_batch",
    "number_and_chunk",
    "pack_title_prompts",
    "dedupe_answers",
    "merge_state",
    ROUND,
    "batched_update_by_ids",
    "merge_sources",
    "image_join_contains",
    "full_feed",
    "semantic_drift",
    "page_text_rules",
    "review_rows",
    "export_approved",
    "enrich_column",
    "python_review",
    "order_lines",
]


def both_texts(spark: SparkSession, folder: str) -> DataFrame:
    titles = run_batched(spark, folder, BatchOptions("title", max_iterations=1))
    return run_batched(spark, folder, BatchOptions("description", max_iterations=1), titles)


def python_review(spark: SparkSession, folder: str) -> DataFrame:
    """A whole review whose model is a Python function."""

    def titles(prompts: list[str], params) -> list[str]:
        return [
            "product attribute keys in original title: brand\nproduct category: c\nproduct attribute keys: brand\n"
            f"product attribute values: b{len(p) % 9}\nreplaced keys:\ngenerated title: t"
            for p in prompts
        ]

    def texts(prompts: list[str], params) -> list[str]:
        return ["description: a text\nscore: 0.7\nreasoning: fine" for _ in prompts]

    def model(ask) -> FunctionCompleter:
        return FunctionCompleter(ask, batch_size=100)

    partitions = spark.sparkContext.defaultParallelism
    return review_feed(filtered(spark, folder), FeedConfig(), model(titles), model(texts), partitions=partitions)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as a feed with hot ids: numbered, packed into chunks, page texts joined."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("id"), F.to_json(F.struct("l_orderkey", "l_quantity")).alias("properties")
    )
    pages = table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("content"))
    chunks = pack_chunks(number_rows(lines, ["id"]), 10)
    return join_page_texts(chunks.select("chunk_id", F.explode("ids").alias("id")), pages)


OWN = {ROUND: both_texts, "python_review": python_review, "order_lines": order_lines}


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("feedlift-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    rows = (OWN.get(name) or catalog.QUERIES[name])(spark, folder)
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    catalog.load()
    names = sys.argv[1:] or HEADLINE
    small = os.path.join(os.path.dirname(folder), "sf0.001")
    warm = small if os.path.isdir(small) else folder
    seconds = {}
    for name in names:
        run(spark, name, warm)
        seconds[name] = round(median(run(spark, name, folder) for _ in range(3)), 3)
    products = spark.read.parquet(f"{folder}/part.parquet").count()
    result = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
        "products": products,
    }
    # The reference estimates 1000 products per minute, bounded by model quotas.
    for name, figure in ((ROUND, "batched"), ("review_rows", "reviewed"), ("python_review", "reviewed_in_python")):
        if name in seconds:
            result[f"products_per_minute_{figure}"] = round(products / seconds[name] * 60)
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

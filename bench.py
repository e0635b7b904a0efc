"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES names, separated by commas (default: the list below)
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "train_set",
    "published_set",
    "context_job",
    "topic_prompts",
    "scenario_prompts",
    "combine_revisions",
    "combine_responses",
    "attach_responses",
    "train_translated",
    "parse_translation",
    "parse_answer",
    "split_reasoning",
    "valid_conversations",
    "token_count",
    "truncate_tokens",
    "sample_n",
    "sample_frac",
    "task_round_robin",
    "row_index",
    "context_prompt_requests",
    "batch_requests",
    "jsonl_roundtrip",
    "collect_stream",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from queries import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weftline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        # no capture of Python call sites for every column that is built
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one small query first: starting the JVM is no part of any query
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

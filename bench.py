"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from authsignal.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "scan_packets",
    "capture_duration",
    "sliding_features",
    "tumbling_features",
    "best_window",
    "online_detection",
    "confidence_gate",
    "weighted_rules",
    "classification_report",
    "window_ids",
    "rate_limit",
    "log_parse",
    "evidence_auth_failures",
    "evidence_sections",
    "keyword_occurrences",
    "response_summary",
    "block_list",
    "metric_rows",
    "augmented_counts",
    "rf_train_predict",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run(name)
        seconds[name] = round(run(name), 3)
    packets = spark.read.parquet(f"{folder}/events.parquet").count()
    captures = QUERIES["capture_duration"](spark, folder).count()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "packets": packets,
                "captures": captures,
                "packets_per_sec_sliding": round(packets / seconds["sliding_features"]),
                "captures_per_sec_detection": round(captures / seconds["online_detection"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

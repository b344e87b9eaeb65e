"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

HEADLINE = ["dup_groups", "dup_report", "dup_quick_staged", "dup_keep_shortest", "dedup_actions", "type_stats", "category_stats", "classify_by_month", "plan_conflict_rename", "plan_counters", "rename_template", "rename_conflict_increment", "resume_anti_join", "journal_resume", "detect_pattern_docs", "human_size"]


def main() -> None:
    from pyspark.sql import SparkSession

    from gleaner import catalogue

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}
    catalogue.QUERIES["type_stats"](spark, sf).collect()  # the first query also starts the session
    for name in HEADLINE:
        began = time.time()
        catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()

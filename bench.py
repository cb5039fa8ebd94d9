"""Time the headline queries on the benchmark tables; prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from ledgerline.plans.cases import QUERIES  # noqa: E402
from ledgerline.storage import drop_materialized  # noqa: E402

HEADLINE = (
    "total_vs_detail", "leave_one_out", "one_multi_scope", "entity_summary", "repeat_suppress", "forward_fill", "contiguous_runs",
    "cascade_lookup", "fuzzy_resolve", "similar_pairs", "canonical_entities", "flatten_pages", "reply_finalise_chat", "page_link",
    "run_checks", "no_total_report", "ledger_analysis",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.minPartitionNum", cpus).config("spark.sql.files.openCostInBytes", "256k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["total_vs_detail"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        drop_materialized(spark)
    spark.stop()
    print(
        json.dumps(
            {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}
        )
    )


if __name__ == "__main__":
    main()

"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tallyforge.plans import catalog

HEADLINE = (
    "exec_summary", "losses_by_state", "losses_by_class", "open_aging", "client_risk", "portfolio_score", "year_breakdown", "carrier_breakdown", "claim_extremes", "first_wins_dedupe", "best_claim_version",
    "carrier_row_merge", "invoice_totals", "reconcile_gap", "unpivot_premiums", "running_balance_audit", "orphan_repair", "asof_backfill", "rating_dedupe", "monitor_stats", "performance_by_type", "ai_usage_by_model",
    "text_quality", "doc_classify", "boundary_ranges", "except_rows",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())

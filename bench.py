"""Benchmark: headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully executed through the ``noop`` sink (every row
computed, nothing collected); a query's time is the best of $BENCH_RUNS
(default 2) runs, i.e. steady state after JIT warm-up.  Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_revenue", "executive_summary", "invoice_summary", "test_report", "quality_gate",
    "cast_gate", "settlement_report", "outcome_rows", "pricing_summary", "apply_decisions",
    "batch_ledger", "classify_route", "review_queue", "trace_order", "table_diff",
    "run_batch", "settlement_batch", "dedupe_orders", "stream_ingest", "diff_detail", "unique_across_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from vendorlake.plans.registry import QUERIES
    from vendorlake.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="vendorlake-bench")
    QUERIES["stg_customers"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            t0 = time.perf_counter()   # includes plan building and any materialization
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            t = time.perf_counter() - t0
            best = t if best is None else min(best, t)
        times[name] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Benchmark the headline reports.

Runs each report on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` (default 8): ``$BENCH_WARMUP`` (default 1) warm-up passes
over all reports (the first also lands the extracts), then per report one warm
run and ``$BENCH_RUNS`` (default 3) timed runs back to back ("median of 3 warm
the ``noop`` sink (every row computed, nothing collected). One daily run follows,
landing and ordered writes included. Prints one JSON line with the median seconds
per query, their sum, and apart from them the seconds of the daily run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.demo.queries import QUERIES  # noqa: E402
from ledgerline.demo.tables import DEMO_PARAMS, DemoTables, land_extracts  # noqa: E402
from ledgerline.plans.daily import run_daily  # noqa: E402
from ledgerline.session import local_session, scratch_dir  # noqa: E402

HEADLINE = [
    "net_invoiced",
    "sales_order",
    "served_invoice",
    "customer_master",
    "net_sellout",
    "price_list_nonvan",
    "price_list_van",
    "uncategorized_skus",
    "loss_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    warmup = int(os.environ.get("BENCH_WARMUP", "1"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus, app="ledgerline-bench")

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for _ in range(warmup):
        for name in HEADLINE:
            run(name)
    timings = {}
    for name in HEADLINE:
        run(name)
        timings[name] = [run(name) for _ in range(runs)]
    medians = {name: round(statistics.median(ts), 3) for name, ts in timings.items()}
    if os.environ.get("BENCH_VERBOSE"):
        print({n: [round(x, 2) for x in ts] for n, ts in timings.items()}, file=sys.stderr)
    t0 = time.perf_counter()
    land_extracts(spark, sf_dir, force=True)
    run_daily(DemoTables(spark, sf_dir), DEMO_PARAMS, f"{scratch_dir(spark)}/bench-daily", "2026-01-02")
    daily = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "sum_of_median_report_seconds",
        "value": round(sum(medians.values()), 3),
        "unit": "sec",
        "queries": medians,
        "daily_run": daily,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "warmup": warmup,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

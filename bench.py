"""Headline queries at one scale factor; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS (default 3).
Each query runs once to warm up, then the median of the repeats is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from merchantry import cases  # noqa: E402
from merchantry.session import local_session  # noqa: E402

HEADLINE = [
    "net_sales_by_area", "net_margin_by_product", "sales_ratios", "sales_summary", "descriptive_stats",
    "purchase_cohort_unrounded", "purchase_requisition", "collection_days", "flow_by_timeframe",
    "sales_basket", "gl_rollup", "income_statement", "ratio_pack", "sync_merge",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    registered = cases.load()
    seconds: dict[str, float] = {}
    for name in names:
        run = cases.runner(registered[name])
        times = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
        "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))


if __name__ == "__main__":
    main()

"""Benchmark of the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` with full materialisation (``write.format('noop')``),
one warm-up then the median of ``$BENCH_RUNS`` runs, and prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    # (bench name, registered query)
    ("mart_daily_losses", "mart_daily_losses_lineitem"),
    ("daily_losses_raw", "daily_losses_raw_lineitem"),
    ("mart_equipment_health", "mart_equipment_health"),
    ("weekly_losses_marts", "weekly_losses_marts_lineitem"),
    ("norm_calibration", "norm_calibration_lineitem"),
    ("dq_summary", "dq_summary_lineitem"),
    ("stream_equipment_health", "stream_equipment_health"),
]


def _driver_memory() -> str:
    """Half of physical memory, between 1 and 8 GiB (local mode: the driver is the executor)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(8, int(total / 2**30 * 0.5)))}g"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    only = [a for a in sys.argv[1:]]

    from opsloss.plans.catalog import queries
    from opsloss.session import build_session

    scratch = tempfile.mkdtemp(prefix="opsloss-bench-")
    spark = build_session(
        f"local[{cpus}]", shuffle_partitions=cpus,
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", _driver_memory()),
               "spark.checkpoint.dir": os.path.join(scratch, "shared")},
    )
    qs = queries()
    results: dict[str, float] = {}
    for bench_name, qname in HEADLINE:
        if only and bench_name not in only:
            continue
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            qs[qname](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                times.append(dt)
        results[bench_name] = round(statistics.median(times), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(results.values()), 3),
        "unit": "sec",
        "queries": results,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()

"""Shuffle volume of headline queries after execution (AQE runtime statistics).

Usage: python tools/shuffle_stats.py [sf_dir]   → appends a section to PLANS.md

For each query: rows read from the fact table and the rows/bytes of every
shuffle stage in the final adaptive plan. A skewed variant of the loss mart
(one operation holding more than a third of all rows) shows that partial
aggregation keeps the shuffle at one row per group and map task.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

STAT = re.compile(r"ShuffleQueryStage \((\d+)\), Statistics\(sizeInBytes=([^,]+), rowCount=([0-9.E+]+)\)")


def shuffle_rows(df) -> list[tuple[str, int]]:
    import io
    from contextlib import redirect_stdout

    df.collect()                      # results are small; runs df's own adaptive plan to its final form
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    final = buf.getvalue().split("\n+- == Initial Plan ==")[0]     # the top-level final plan
    seen, out = set(), []
    for stage, size, rows in STAT.findall(final):
        if stage not in seen:
            seen.add(stage)
            out.append((size, int(float(rows))))
    return out


def main() -> None:
    from pyspark.sql import functions as F

    from opsloss.operators import losses as L
    from opsloss.plans.catalog import queries
    from opsloss.plans.models import Models
    from opsloss.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 8)
    qs = queries()
    lines = ["", "## Shuffle volume at runtime", "",
             f"`tools/shuffle_stats.py` on `{sf_dir}`: rows of the fact input and of each shuffle stage "
             "(AQE final plan statistics; the tiny dimension stages are included).", "",
             "| Query | Fact rows | Shuffle stages (rows) |", "|---|---|---|"]
    n_li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    n_ev = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    for name, n in [("mart_daily_losses_lineitem", n_li), ("daily_losses_raw_lineitem", n_li),
                    ("mart_equipment_health", n_ev), ("norm_calibration_lineitem", n_li),
                    ("latest_order_per_customer", None)]:
        st = shuffle_rows(qs[name](spark, sf_dir))
        lines.append(f"| `{name}` | {n if n is not None else '—'} | {', '.join(str(r) for _, r in st)} |")
    # skew: the facts three times, the extra copies all re-labelled to one operation
    m = Models(spark, sf_dir, "lineitem")
    ev = m.event_logs
    hot = ev.withColumn("operation_name", F.lit("AF"))
    skewed = ev.unionByName(hot).unionByName(hot)
    from opsloss.operators import staging
    mart = L.mart_daily_losses(L.ops_enriched(staging.stg_event_logs(skewed), m.dims))
    st = shuffle_rows(mart)
    lines.append(f"| mart, skewed (`AF` holds > ⅔ of {3 * n_li} rows) | {3 * n_li} | "
                 f"{', '.join(str(r) for _, r in st)} |")
    spark.stop()
    with open(os.path.join(ROOT, "PLANS.md"), "a") as f:
        f.write("\n".join(lines) + "\n")
    print("\n".join(lines))


if __name__ == "__main__":
    main()

"""Command line for the scheduled jobs.

    python -m opsloss daily     --norms N --rates R [--date YYYY-MM-DD | --all-dates] [--mode raw|marts] ...
    python -m opsloss weekly    --norms N --rates R [--week-start YYYY-MM-DD] [--mode raw|marts] ...
    python -m opsloss retain    --warehouse DIR [--asof YYYY-MM-DD]
    python -m opsloss calibrate --sf-dir DIR --out DIR [--asof YYYY-MM-DD] [--lookback-days 30]
    python -m opsloss ingest    --batches DIR --warehouse DIR [--kind events|readings]
    python -m opsloss stream    --events DIR --readings DIR --warehouse DIR --norms N --rates R
    python -m opsloss maintain  --warehouse DIR

Run it with ``spark-submit`` on a cluster (the master comes from there) or
with ``--master local[N]``. Dates are parsed strictly (F16); a bad date exits
with status 1. Without ``--date`` the daily job reports today, with
``--all-dates`` it back-fills every date of the marts or the raw log; without ``--week-start``
the weekly job reports last week (F15). ``--norms`` and ``--rates`` are folders
in the format ``--dims-format``, or tables of ``--jdbc-url``. Facts come from
``--sf-dir``, or with ``--stored-facts`` from the warehouse.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import json
import sys

from .functions.dates import parse_date_strict, previous_week_monday


def _date(value: str | None) -> _dt.date | None:
    if value is None:
        return None
    try:
        return parse_date_strict(value)
    except ValueError:
        print(f"invalid date {value!r}, expected YYYY-MM-DD", file=sys.stderr)
        sys.exit(1)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="opsloss")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="cmd", required=True)
    d = sub.add_parser("daily")
    d.add_argument("--date")
    d.add_argument("--all-dates", action="store_true")
    d.add_argument("--report-format", default="parquet", choices=["parquet", "csv"])
    w = sub.add_parser("weekly")
    w.add_argument("--week-start")
    for job in (d, w):
        facts = job.add_mutually_exclusive_group(required=True)
        facts.add_argument("--sf-dir")
        facts.add_argument("--stored-facts", action="store_true",
                           help="read facts from the warehouse tables filled by `ingest`")
        job.add_argument("--warehouse")
        job.add_argument("--source", default="events", choices=["events", "lineitem"])
        job.add_argument("--mode", default="raw", choices=["raw", "marts"])
    r = sub.add_parser("stream")
    r.add_argument("--events")
    r.add_argument("--readings")
    r.add_argument("--warehouse", required=True)
    for job in (d, w, r):
        job.add_argument("--norms", required=True)
        job.add_argument("--rates", required=True)
        job.add_argument("--dims-format", default="parquet")
        job.add_argument("--jdbc-url")
    u = sub.add_parser("maintain")
    u.add_argument("--warehouse", required=True)
    t = sub.add_parser("retain")
    t.add_argument("--warehouse", required=True)
    t.add_argument("--asof")
    c = sub.add_parser("calibrate")
    c.add_argument("--sf-dir", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--asof")
    c.add_argument("--lookback-days", type=int, default=30)
    c.add_argument("--source", default="events", choices=["events", "lineitem"])
    i = sub.add_parser("ingest")
    i.add_argument("--batches", required=True)
    i.add_argument("--warehouse", required=True)
    i.add_argument("--kind", default="events", choices=["events", "readings"])
    a = p.parse_args(argv)

    # arguments are validated before any Spark work starts
    today = _dt.datetime.now(_dt.timezone.utc).date()
    if a.cmd == "daily" and a.all_dates and a.date:
        p.error("--all-dates takes no --date")
    report_date = None if getattr(a, "all_dates", False) else _date(getattr(a, "date", None)) or today
    week = _date(getattr(a, "week_start", None)) or previous_week_monday(today)
    asof = _dt.datetime.combine(_date(getattr(a, "asof", None)) or today, _dt.time())

    from .plans import jobs as J
    from .session import build_session
    from .sources.dims import read_source

    spark = build_session(a.master)
    wh = J.Warehouse(a.warehouse) if getattr(a, "warehouse", None) else None
    if a.cmd in ("daily", "weekly", "stream"):
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        dims = read_source(spark, a.norms, a.rates, *(("jdbc",) if a.jdbc_url else (a.dims_format,)),
                           **({"url": a.jdbc_url} if a.jdbc_url else {}))
    if a.cmd == "daily":
        out = J.daily_run(spark, a.sf_dir, now, dims, wh, report_date=report_date, source=a.source,
                          stored_facts=a.stored_facts, report_format=a.report_format, mode=a.mode)
    elif a.cmd == "weekly":
        out = J.weekly_run(spark, a.sf_dir, now, dims, wh, week_start=week, source=a.source,
                           stored_facts=a.stored_facts, mode=a.mode)
    elif a.cmd == "stream":
        out = J.stream_run(spark, {k: v for k, v in (("events", a.events), ("readings", a.readings)) if v}, wh, now, dims)
    elif a.cmd == "maintain":
        out = J.maintain(spark, wh)
    elif a.cmd == "retain":
        out = J.apply_retention(spark, wh.path("raw", "scada_telemetry"), asof)
    elif a.cmd == "calibrate":
        out = {"csv": J.norm_calibration_run(spark, a.sf_dir, asof, a.out, a.lookback_days, a.source)}
    else:
        out = J.ingest_job(spark, a.batches, wh, a.kind)
    print(json.dumps(out, default=str))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

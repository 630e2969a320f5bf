"""Table layout and sinks.

Facts and marts are snapshot tables (``snapshots``): Parquet in month folders (``yyyyMM``), sorted within
files by their sort key, so date predicates prune folders and min/max statistics prune row groups. A run
writes new folders beside the old ones and then names its version in a pointer. Marts are rebuilt by
months: the version keeps the folders of all other months (the "last write per key wins" of C2 without
a version column), and nothing is deleted before the new version is in place.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_key, ts_literal
from . import snapshots as SN
from .snapshots import MONTH, delete_path, list_dirs, path_exists  # noqa: F401

# Sort keys of the stored tables.
SORT_KEYS = {
    "event_logs": ["operation_name", "start_time"],
    "scada_telemetry": ["equipment_id", "metric_name", "ts"],
    "mart_daily_losses": ["event_date", "operation_name"],
    "mart_equipment_health": ["reading_date", "equipment_id", "metric_name"],
}
TIME_COLUMN = {
    "event_logs": "start_time",
    "scada_telemetry": "ts",
    "mart_daily_losses": "event_date",
    "mart_equipment_health": "reading_date",
}


def with_month(df: DataFrame, table: str) -> DataFrame:
    """Add the monthly partition column of a known table."""
    return df.withColumn(MONTH, month_key(TIME_COLUMN[table]))


def _layout(df: DataFrame, table: str) -> DataFrame:
    d = df if MONTH in df.columns else with_month(df, table)
    return d.sortWithinPartitions(MONTH, *SORT_KEYS[table])


def append(df: DataFrame, path: str, table: str) -> None:
    """A1/A2 sink: append, in month folders. Rows stay in the tasks that have them; ``compact`` clusters later."""
    parts = SN.stage(_layout(df, table), path, (MONTH,))
    SN.update(df.sparkSession, path, lambda base: ((*base.parts, *parts), None))


def overwrite_partitions(df: DataFrame, path: str, table: str, whole: bool = False, months: Iterable[str] = ()) -> None:
    """Replace the months present in ``df`` and those of ``months`` (which may have no rows any more), or
    with ``whole`` the table. Rows are dealt by month first (AQE splits a large month), so a month is a few
    files, not one for each task. Readers see the old version until the new one is complete."""
    d = df if MONTH in df.columns else with_month(df, table)
    parts = SN.stage(_layout(d.hint("rebalance", MONTH), table), path, (MONTH,))
    gone = set(months) | {p.month for p in parts}
    SN.update(df.sparkSession, path, lambda base: (
        (*[p for p in base.parts if not whole and p.month not in gone], *parts), None))


def create_if_absent(spark: SparkSession, path: str) -> None:
    """An empty table, left alone when it exists."""
    base = SN.current(spark, path)
    if not base.number:
        SN.publish(spark, path, base, ())


def list_months(spark: SparkSession, path: str) -> list[str]:
    """The months a table has rows of, from its pointer."""
    return sorted({p.month for p in SN.current(spark, path).of() if p.month})


def compact(spark: SparkSession, path: str, table: str, schema, file_bytes: int = 128 << 20) -> dict[str, int]:
    """Merge the small files of each month into files of about ``file_bytes``, clustered by the sort key.

    Months with no more files than their bytes need, in one folder, are left alone. The others are read in one
    job, dealt by ranges of (month, sort key) whose number follows from the bytes, and published in
    place of the old folders; months written meanwhile keep their new folders too. A key that holds a third of
    a month is split by the rest of the sort key. Returns the files of each rewritten month before.
    """
    base = SN.current(spark, path)
    sizes: dict[str, list[int]] = {}
    folders: dict[str, int] = {}
    for p in base.of():
        fs, place = SN.file_system(spark, f"{path}/{p.path}")
        sizes.setdefault(p.month, []).extend(st.getLen() for st in fs.listStatus(place) if st.getPath().getName().endswith(".parquet"))
        folders[p.month] = folders.get(p.month, 0) + 1
    need = {m: max(1, -(-sum(x) // file_bytes)) for m, x in sizes.items()}
    todo = sorted(m for m, x in sizes.items() if folders[m] > 1 or len(x) > 2 * need[m])
    if not todo:
        return {}
    old = SN.Snapshot(base.number, tuple(p for p in base.of() if p.month in todo))
    rows = SN.read(spark, path, schema, with_month=True, at=old)
    dealt = rows.repartitionByRange(sum(need[m] for m in todo), MONTH, *SORT_KEYS[table])
    parts = SN.stage(_layout(dealt, table), path, (MONTH,))
    gone = {p.path for p in old.parts}

    def change(now: SN.Snapshot):
        if not gone <= {p.path for p in now.parts}:
            raise RuntimeError(f"{path}: a month was rewritten during its compaction")
        return (*[p for p in now.parts if p.path not in gone], *parts), None

    SN.update(spark, path, change)
    return {m: len(sizes[m]) for m in todo}


def month_bound(df: DataFrame, since: _dt.date | _dt.datetime | None = None,
                until: _dt.date | _dt.datetime | None = None) -> DataFrame:
    """Add ``month`` predicates equivalent to a time window, so a
    month-partitioned table is pruned (a no-op on frames without ``month``)."""
    if MONTH not in df.columns:
        return df
    if since is not None:
        df = df.filter(F.col(MONTH) >= F.lit(since.strftime("%Y%m")))
    if until is not None:
        df = df.filter(F.col(MONTH) <= F.lit(until.strftime("%Y%m")))
    return df


def years_before(asof: _dt.datetime, years: int) -> _dt.datetime:
    """The same day ``years`` earlier; 28 February for a leap day."""
    try:
        return asof.replace(year=asof.year - years)
    except ValueError:
        return asof.replace(year=asof.year - years, day=28)


def retention_filter(telemetry: DataFrame, asof: _dt.datetime, years: int = 1) -> DataFrame:
    """Keep readings whose second-truncated time plus ``years`` is after ``asof``.

    ``telemetry`` may carry the ``month`` column; then an equivalent month
    bound is added so whole expired partitions are pruned, not scanned.
    """
    # session zone is UTC, so NTZ → TIMESTAMP keeps the wall-clock value
    trunc = F.date_trunc("second", F.col("ts").cast("timestamp"))
    keep = (trunc + F.make_ym_interval(F.lit(years), F.lit(0))) > ts_literal(asof).cast("timestamp")
    out = telemetry.filter(keep)
    if MONTH in telemetry.columns:
        cutoff = years_before(asof, years)
        out = out.filter(F.col(MONTH) >= F.lit(cutoff.strftime("%Y%m")))
    return out


def write_csv_report(df: DataFrame, out_dir: str, run_date: _dt.date) -> str:
    """CSV with header, one key per run date, overwritten on rerun."""
    path = f"{out_dir}/run_date={run_date:%Y-%m-%d}"
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def run_concurrently(actions: list[Callable[[], object]], max_workers: int = 8) -> list[object]:
    """Submit independent Spark actions (e.g. writes of separate tables) as
    concurrent jobs, so small jobs share the cluster instead of queueing."""
    if len(actions) <= 1:
        return [a() for a in actions]
    with ThreadPoolExecutor(max_workers=min(max_workers, len(actions))) as pool:
        return [f.result() for f in [pool.submit(a) for a in actions]]


def write_report_tables(tables: dict[str, DataFrame], out_dir: str, report_key: str,
                        fmt: str = "parquet") -> dict[str, str]:
    """A21 (re-aimed): the report's tables under ``<table>/report=<key>``, as
    Parquet (for further processing) or CSV with a header (for people);
    rerunning a report replaces it."""
    paths = {name: f"{out_dir}/{name}/report={report_key}" for name in tables}

    def write(df: DataFrame, path: str) -> None:
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.parquet(path)

    run_concurrently([lambda df=df, p=paths[n]: write(df, p) for n, df in tables.items()])
    return paths

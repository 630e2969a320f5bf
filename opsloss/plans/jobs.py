"""Scheduled jobs (M15-M17) and table maintenance.

A job is one driver function over one SparkSession: sync the dimensions,
rebuild the touched mart months, run the data-quality checks and gate, then
write the report tables. Every intermediate result that later steps read is
a written table under the warehouse root (a folder in the shared
``spark.checkpoint.dir`` unless given), so a lost executor costs a task
retry. Facts, dimensions and marts are snapshot tables: a step's rows become
visible at once when it is complete, and a failed job is simply run again.
"""

from __future__ import annotations

import datetime as _dt
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import quality as Q
from ..operators import reports as Rp
from ..operators import narrative as N
from ..operators import versioning as V
from ..operators import joins as J
from ..session import fresh_dir, observed
from ..sources import snapshots as SN
from ..sources import storage as ST
from .models import Models


@dataclass
class Warehouse:
    root: str

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)

    @property
    def dim_norms(self) -> str:
        return self.path("dims", "dim_process_norms")

    @property
    def dim_rates(self) -> str:
        return self.path("dims", "dim_rates")

    @property
    def mart_losses(self) -> str:
        return self.path("marts", "mart_daily_losses")

    @property
    def mart_health(self) -> str:
        return self.path("marts", "mart_equipment_health")


def new_warehouse(spark: SparkSession) -> Warehouse:
    return Warehouse(fresh_dir(spark, "warehouse"))


def create_tables(spark: SparkSession, wh: Warehouse) -> None:
    """The six tables exist (empty) before any job step runs."""
    for path in (wh.path("raw", "event_logs"), wh.path("raw", "scada_telemetry"), wh.mart_losses, wh.mart_health,
                 wh.dim_norms, wh.dim_rates):
        ST.create_if_absent(spark, path)


# ---------------------------------------------------------------- M15

REDUCE_EVERY = 16      # appended folders after which a dimension's log is reduced


def read_dim(spark: SparkSession, path: str, schema) -> DataFrame:
    """A versioned dimension log."""
    return SN.read(spark, path, schema)


def _append_dim(rows: DataFrame, path: str, name: str) -> int:
    from pyspark.sql import Observation

    seen = Observation(name)
    parts = SN.stage(rows.observe(seen, F.count(F.lit(1)).alias("n")), path)
    n = observed(seen, "n")
    if n:
        SN.update(rows.sparkSession, path, lambda base: ((*base.parts, *parts), None))
    return n


def sync_dims(norms_src: DataFrame, rates_src: DataFrame, wh: Warehouse, synced_at: _dt.datetime) -> dict[str, int]:
    """M15 (A10, E10, C3): append the stamped rows of each non-empty source that are new or differ from the
    latest version; the rows appended of each. A sync without changes appends nothing, so the log grows with the changes only, and after
    ``REDUCE_EVERY`` appended folders it is reduced to the latest versions."""
    spark, done = norms_src.sparkSession, {}
    for src, path, name, schema in ((rates_src, wh.dim_rates, "rates", schemas.RATES_VERSIONED),
                                    (norms_src, wh.dim_norms, "norms", schemas.NORMS_VERSIONED)):
        if src.isEmpty():
            continue
        log = read_dim(spark, path, schema)
        done[name] = _append_dim(V.stamp_snapshot(V.changed_rows(src, log, "id"), synced_at), path, name)
        if len(SN.current(spark, path).parts) >= REDUCE_EVERY:
            reduce_dim(spark, path, schema)
    return done


def reduce_dim(spark: SparkSession, path: str, schema) -> int:
    """Replace a dimension's log by its latest version per id; the rows kept. Folders appended meanwhile stay."""
    base = SN.current(spark, path)
    log = SN.read(spark, path, schema, at=base)
    parts = SN.stage(V.latest_by_key(log.withColumn("_at", F.col("updated_at")), "id")
                     .withColumnRenamed("_at", "updated_at").select(*[f.name for f in schema.fields]), path)
    old = set(base.parts)
    now = SN.update(spark, path, lambda new: ((*parts, *[p for p in new.parts if p not in old]), None))
    return SN.read(spark, path, schema, at=now).count()


# ---------------------------------------------------------------- A5-A8

def list_rates(spark: SparkSession, wh: Warehouse) -> DataFrame:
    """The current rates by id."""
    return V.latest_by_key(read_dim(spark, wh.dim_rates, schemas.RATES_VERSIONED), "id").orderBy("id")


def list_norms(spark: SparkSession, wh: Warehouse) -> DataFrame:
    """The current norms by id."""
    return V.latest_by_key(read_dim(spark, wh.dim_norms, schemas.NORMS_VERSIONED), "id").orderBy("id")


def _create(requests: DataFrame, existing: DataFrame, unique: str, schema, path: str, at: _dt.datetime) -> int:
    new = J.assign_ids(J.new_rows_only(requests, existing, unique, "request_seq"), existing, "id", "request_seq")
    rows = V.stamp_snapshot(new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), at)
    return _append_dim(rows, path, "created")


def create_rates(spark: SparkSession, requests: DataFrame, wh: Warehouse, at: _dt.datetime) -> int:
    """A5: append the requested rates (``request_seq, role_name, hourly_rate``) whose role is new; how many."""
    return _create(requests, list_rates(spark, wh), "role_name", schemas.RATES, wh.dim_rates, at)


def create_norms(spark: SparkSession, requests: DataFrame, wh: Warehouse, at: _dt.datetime) -> int:
    """Append the requested norms (``request_seq, operation_name, norm_seconds, role_id``) whose role
    exists and whose operation is new; how many."""
    accepted, _ = J.accept_with_parent(requests, list_rates(spark, wh), "role_id", "id")
    return _create(accepted, list_norms(spark, wh), "operation_name", schemas.NORMS, wh.dim_norms, at)


def read_event_logs(spark: SparkSession, path: str) -> DataFrame:
    """The stored event log, with ``month``."""
    return SN.read(spark, path, schemas.EVENT_LOGS, with_month=True)


def warehouse_models(spark: SparkSession, sf_dir: str, wh: Warehouse, source: str = "events",
                     stored_facts: bool = False, given: tuple[DataFrame, DataFrame] | None = None) -> Models:
    """Models over the warehouse dimensions; with ``stored_facts`` the facts
    are the warehouse's month-partitioned tables (filled by ``ingest_job``)
    instead of the adapters over ``sf_dir``."""
    facts, tel = given or (None, None)
    if stored_facts:
        facts = read_event_logs(spark, wh.path("raw", "event_logs"))
        tel = read_telemetry(spark, wh.path("raw", "scada_telemetry"))
    return Models(spark, sf_dir, source,
                  norms_versioned=read_dim(spark, wh.dim_norms, schemas.NORMS_VERSIONED),
                  rates_versioned=read_dim(spark, wh.dim_rates, schemas.RATES_VERSIONED),
                  event_logs=facts, telemetry=tel)


# ---------------------------------------------------------------- marts

def month_start(d: _dt.date) -> _dt.date:
    return d.replace(day=1)


def next_month(d: _dt.date) -> _dt.date:
    return month_start(month_start(d) + _dt.timedelta(days=31))


def bounded_models(models: Models, since: _dt.date, until: _dt.date | None = None, watch=None) -> Models:
    """The same model graph over facts from ``since``'s month to ``until``'s month (to the end when None). The time
    bounds reach the Parquet scan; month predicates prune a stored fact table."""
    lo = month_start(since)

    def between(facts: DataFrame, time: str) -> DataFrame:
        facts = ST.month_bound(facts, lo, until).filter(F.col(time) >= F.lit(lo).cast("timestamp_ntz"))
        return facts if until is None else facts.filter(F.col(time) < F.lit(next_month(until)).cast("timestamp_ntz"))

    return Models(models.spark, models.sf_dir, models.source,
                  norms_versioned=models.norms_versioned, rates_versioned=models.rates_versioned,
                  event_logs=between(models.event_logs, "start_time"),
                  telemetry=between(models.telemetry, "ts"), watch=watch or models.watch)


def build_marts(models: Models, wh: Warehouse, since: _dt.date | None = None, until: _dt.date | None = None,
                watch=None) -> None:
    """Rebuild both marts for the months of ``since`` to ``until`` (all when ``since`` is None, to the last
    one when ``until`` is None).

    The range is snapped to whole months, so each rewritten month is complete; other months are left
    alone. Each mart changes at once, when all its new months are written; months of the range that have
    no rows any more go with the same pointer.
    """
    if since is not None:
        models = bounded_models(models, since, until, watch)
    elif watch is not None:
        models = Models(models.spark, models.sf_dir, models.source, models.norms_versioned, models.rates_versioned,
                        models.event_logs, models.telemetry, watch)
    losses, health = models.mart_daily_losses, models.mart_equipment_health
    stale: dict[str, list[str]] = {wh.mart_losses: [], wh.mart_health: []}
    if since is not None:
        lo, last = month_start(since), until.strftime("%Y%m") if until else None
        losses = _in_months(losses, "event_date", lo, until)
        health = _in_months(health, "reading_date", lo, until)
        stale = {path: [m for m in ST.list_months(models.spark, path)
                        if m >= lo.strftime("%Y%m") and (last is None or m <= last)] for path in stale}
    ST.run_concurrently([
        lambda: ST.overwrite_partitions(losses, wh.mart_losses, "mart_daily_losses", since is None, stale[wh.mart_losses]),
        lambda: ST.overwrite_partitions(health, wh.mart_health, "mart_equipment_health", since is None, stale[wh.mart_health]),
    ])


def _in_months(mart: DataFrame, day: str, since: _dt.date, until: _dt.date | None) -> DataFrame:
    """Rows from the month of ``since`` to the month of ``until``, whole months."""
    mart = mart.filter(F.col(day) >= F.lit(since))
    if until is None:
        return mart
    return mart.filter(F.col(day) < F.lit(next_month(until)))


def read_mart(spark: SparkSession, path: str, schema, keep_month: bool = False) -> DataFrame:
    """A stored mart with its fixed schema (an empty mart reads as empty).

    ``keep_month`` keeps the folder column, so date filters applied later
    (``month_bound`` in the report readers) prune whole months.
    """
    return SN.read(spark, path, schema, with_month=keep_month)


# ---------------------------------------------------------------- M16 / M17

def daily_run(spark: SparkSession, sf_dir: str | None, synced_at: _dt.datetime, dims: tuple[DataFrame, DataFrame],
              wh: Warehouse | None = None, report_date: _dt.date | None = None, source: str = "events",
              top_n: int = Rp.DEFAULT_TOP_N, stored_facts: bool = False,
              report_format: str = "parquet", mode: str = "marts",
              facts: tuple[DataFrame, DataFrame] | None = None) -> dict[str, str]:
    """Sync → marts → checks → gate → report tables.

    ``dims``: the source's current (norms, rates), synced with the stamp ``synced_at``. ``mode``: the
    report reads the ``marts`` or the ``raw`` log. ``facts``: (event log, telemetry) to use instead of the source's.

    ``report_date=None`` back-fills reports for every date of the mart and
    checks all facts; with a date only that date's month is rebuilt and its
    facts checked (the stored marts are checked whole).
    """
    wh = wh or new_warehouse(spark)
    create_tables(spark, wh)
    sync_dims(*dims, wh, synced_at)
    every = warehouse_models(spark, sf_dir, wh, source, stored_facts, facts)
    # the checks of rows are counted while the marts are written: staging checks cover what this run
    # rebuilds (earlier months were checked by earlier runs); a back-fill (no date) checks everything
    checks = Q.WriteChecks()
    build_marts(every, wh, report_date, report_date, checks.watch)

    mart = read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES, keep_month=True)
    health = read_mart(spark, wh.mart_health, schemas.MART_EQUIPMENT_HEALTH)
    checks.summary(every.stg_norms, every.stg_rates, mart, health).write.mode("overwrite").parquet(wh.path("checks", "dq_summary"))
    Q.verdict(spark.read.parquet(wh.path("checks", "dq_summary"))).write.mode("overwrite").parquet(wh.path("checks", "verdict"))
    Q.gate(spark.read.parquet(wh.path("checks", "verdict")))

    r = Rp.build_daily_report(mode, report_date, top_n, mart=mart, event_logs=every.event_logs, dims=every.dims)
    tables = {
        "pulse": r.pulse,
        "losses": r.loss_table,
        "analysis": r.analysis,
        "anomalies": r.anomalies,
        "prompts": N.anomaly_prompts(r.anomalies),
        "captions": N.report_captions(r.totals),
    }
    key = "all" if report_date is None else f"{report_date:%Y-%m-%d}"
    return ST.write_report_tables(tables, wh.path("reports", "daily"), key, report_format)


def weekly_run(spark: SparkSession, sf_dir: str | None, synced_at: _dt.datetime, dims: tuple[DataFrame, DataFrame],
               wh: Warehouse | None = None, week_start: _dt.date | None = None, source: str = "events",
               top_n: int = Rp.DEFAULT_TOP_N, stored_facts: bool = False, mode: str = "marts") -> dict[str, str]:
    """Sync → marts → weekly report (no quality gate, as scheduled); arguments as in ``daily_run``."""
    wh = wh or new_warehouse(spark)
    create_tables(spark, wh)
    sync_dims(*dims, wh, synced_at)
    models = warehouse_models(spark, sf_dir, wh, source, stored_facts)
    build_marts(models, wh, week_start, week_start + _dt.timedelta(days=6) if week_start else None)
    mart = read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES, keep_month=True)
    r = Rp.build_weekly_report(mode, week_start, top_n, mart=mart, event_logs=models.event_logs)
    if r.losses.isEmpty():        # S27: an empty week produces no report at all
        return {}
    tables = dict(r) | {"prompts": N.anomaly_prompts(r.anomalies, "week_start"),
                        "captions": N.report_captions(r.totals, "week_start")}
    key = "all" if week_start is None else f"{week_start:%Y-%m-%d}"
    return ST.write_report_tables(tables, wh.path("reports", "weekly"), key)


def norm_calibration_run(spark: SparkSession, sf_dir: str, asof: _dt.datetime, out_dir: str,
                         lookback_days: int = 30, source: str = "events") -> str:
    """M14 + A20: calibration written as CSV under ``run_date=…`` (never applied, S24)."""
    from ..operators import calibration as C

    m = Models(spark, sf_dir, source)
    result = C.norm_calibration(C.calibration_stats(C.calibration_window(m.event_logs, asof, lookback_days)),
                                m.stg_norms)
    return ST.write_csv_report(result.orderBy("operation_name"), out_dir, asof.date())


# ---------------------------------------------------------------- A17

def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The stored telemetry, with ``month``."""
    return SN.read(spark, path, schemas.TELEMETRY, with_month=True)


def apply_retention(spark: SparkSession, path: str, asof: _dt.datetime, years: int = 1) -> dict[str, list[str]]:
    """A17 on the stored telemetry; work is one month.

    * months wholly past the horizon leave the table's next version (no data read);
    * the one boundary month is filtered row by row into a new folder;
    * later months are not touched.
    ``snapshots.vacuum`` frees the disk. Re-running with the same ``asof`` is a no-op on the result.
    """
    boundary = ST.years_before(asof, years).strftime("%Y%m")
    base = SN.current(spark, path)
    months = sorted({p.month for p in base.of() if p.month})
    expired = [m for m in months if m < boundary]
    old = {p for p in base.of() if p.month is not None and p.month <= boundary}
    parts = []
    if boundary in months:
        part = SN.read(spark, path, schemas.TELEMETRY, with_month=True,
                       at=SN.Snapshot(base.number, tuple(p for p in base.of() if p.month == boundary)))
        parts = SN.stage(ST._layout(ST.retention_filter(part, asof, years), "scada_telemetry"), path, (ST.MONTH,))
    if old:
        SN.update(spark, path, lambda now: ((*[p for p in now.parts if p not in old], *parts), None))
    return {"dropped": expired, "rewritten": [boundary] if boundary in months else []}


# ---------------------------------------------------------------- A1-A4 as a job

FILE, REJECT = "file", "reject"


def ingest_job(spark: SparkSession, batch_dir: str, wh: Warehouse, kind: str = "events") -> dict[str, int]:
    """Take the request files of ``batch_dir`` that no earlier run has taken: accepted rows, one record per rejected
    batch and the list of the files; returns ``{"inserted": n, "rejected_batches": m, "files": k}``.

    The files are parsed once; rows and rejects go through one write. Rows, rejects and file list become part of the
    table with one pointer, so a run that fails leaves nothing behind and can be repeated, and a repeated
    run finds no new files. A file is known by its path, size and time of change.
    """
    from pyspark.sql import Observation

    from ..sources import ingest as I

    root = wh.path("raw", I.TABLES[kind])
    base = SN.current(spark, root)
    found = I.request_files(spark, batch_dir)
    new = found.join(SN.read(spark, root, I.FILES, FILE, at=base), found.columns, "left_anti")
    paths = [r.path for r in new.select("path").collect()]       # file names only, as any reader lists them
    if not paths:
        return {"inserted": 0, "rejected_batches": 0, "files": 0}
    items = I.items(I.validated(I.read_lines(spark, paths), kind), kind)
    seen, is_row = Observation("ingest"), F.col(SN.KIND) == SN.ROW
    items = items.observe(seen, F.count_if(is_row).alias("rows"), F.count_if(~is_row).alias("rejects"))
    order = [SN.KIND, ST.MONTH, *ST.SORT_KEYS[I.TABLES[kind]]]
    parts = SN.stage(items.sortWithinPartitions(*order), root, (SN.KIND, ST.MONTH))
    parts += SN.stage(new, root, kind=FILE)
    SN.publish(spark, root, base, (*base.parts, *parts))          # a second run at the same time fails here
    return {"inserted": observed(seen, "rows"), "rejected_batches": observed(seen, "rejects"), "files": len(paths)}


def ingest_rejects(spark: SparkSession, wh: Warehouse, kind: str = "events") -> DataFrame:
    """The rejected batches of all runs: batch_id, batch_part, reject_reason, row_count."""
    from ..sources import ingest as I

    return SN.read(spark, wh.path("raw", I.TABLES[kind]), I.BATCH, REJECT)


# ---------------------------------------------------------------- J1-J4 as a job

def stream_run(spark: SparkSession, requests: dict[str, str], wh: Warehouse, synced_at: _dt.datetime,
               dims: tuple[DataFrame, DataFrame]) -> dict[str, dict[str, int]]:
    """One round of the streams: take in the new request files of both kinds (``requests``: kind to folder), add their rows to the
    partials, sync the dimensions and bring the loss mart up to date. Each stream goes on from its own checkpoint,
    so a round that fails is run again, and a round without news only syncs. Returns what each step did."""
    from ..streaming import aggregates as SA
    from ..streaming import ingest as SI

    done: dict[str, dict[str, int]] = {}
    for kind, folder in requests.items():
        root, done[kind] = SI.stream_ingest(spark, folder, wh.path("streams", kind), kind)
        run = SA.run_losses if kind == "events" else SA.run_health
        run(SI.rows_stream(spark, root, kind), wh.path("streams", f"{kind}_mart"))
    done["dims"] = sync_dims(*dims, wh, synced_at)
    if "events" in requests:
        m = warehouse_models(spark, None, wh)
        done["losses"] = SA.refresh_losses(spark, wh.path("streams", "events_mart"), m.dims)
    return done


def streamed_losses(spark: SparkSession, wh: Warehouse) -> DataFrame:
    from ..streaming import aggregates as SA

    return SA.losses_mart(spark, wh.path("streams", "events_mart"))


def streamed_health(spark: SparkSession, wh: Warehouse) -> DataFrame:
    from ..streaming import aggregates as SA

    return SA.health_mart(spark, wh.path("streams", "readings_mart"))


# ---------------------------------------------------------------- upkeep

def maintain(spark: SparkSession, wh: Warehouse, keep: int = 2, older_than: float = 7 * 86400) -> dict[str, dict]:
    """Compact the fact tables, reduce the dimensions' logs, and free the data of old versions and failed runs."""
    facts = {"event_logs": schemas.EVENT_LOGS, "scada_telemetry": schemas.TELEMETRY}
    out: dict[str, dict] = {t: {"compacted": ST.compact(spark, wh.path("raw", t), t, s)} for t, s in facts.items()}
    for path, schema in ((wh.dim_norms, schemas.NORMS_VERSIONED), (wh.dim_rates, schemas.RATES_VERSIONED)):
        if len(SN.current(spark, path).parts) > 1:
            out[os.path.basename(path)] = {"kept": reduce_dim(spark, path, schema)}
    for path in (*[wh.path("raw", t) for t in facts], wh.dim_norms, wh.dim_rates, wh.mart_losses, wh.mart_health,
                 *[wh.path("streams", f"{k}_mart", x) for k in ("events", "readings") for x in ("partials", "mart")]):
        gone = SN.vacuum(spark, path, keep, older_than)
        if gone:
            out.setdefault(os.path.relpath(path, wh.root), {})["vacuumed"] = len(gone)
    return out

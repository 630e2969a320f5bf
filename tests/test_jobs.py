"""Jobs: daily run writes gated reports; calibration CSV; partition rewrite; retention."""

import datetime as dt
import os

from pyspark.sql import functions as F

from opsloss import schemas
from opsloss.plans import jobs as JB
from opsloss.plans.models import Models
from opsloss.session import fresh_dir
from opsloss.sources import dims as D
from opsloss.sources import adapters as A
from opsloss.sources import storage as ST
from tests.conftest import SF_SMALL

STAMP = dt.datetime(2024, 2, 1, 6)


def test_daily_run_single_date(spark):
    wh = JB.new_warehouse(spark)
    paths = JB.daily_run(spark, SF_SMALL, STAMP, D.sample_rows(spark), wh, report_date=dt.date(2024, 1, 10))
    (p,) = spark.read.parquet(paths["pulse"]).collect()
    assert p.report_date == dt.date(2024, 1, 10) and p.anomaly_count <= 3
    # tables created up front (A18) and dims synced twice stay idempotent on read
    assert os.path.isdir(wh.path("raw", "event_logs"))
    JB.daily_run(spark, SF_SMALL, STAMP, D.sample_rows(spark), wh, report_date=dt.date(2024, 1, 10))
    assert JB.read_dim(spark, wh.dim_norms, schemas.NORMS_VERSIONED).count() == 9      # the second sync changed nothing


def test_dated_build_leaves_other_months(spark):
    wh = JB.new_warehouse(spark)
    JB.create_tables(spark, wh)
    models = Models(spark, SF_SMALL, "lineitem")
    JB.build_marts(models, wh)
    full = {str(r.month): r["count"] for r in JB.read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES, keep_month=True).groupBy("month").count().collect()}
    some = sorted(full)[2]
    day = dt.date(int(some[:4]), int(some[4:]), 28)
    fewer = Models(spark, SF_SMALL, "lineitem", event_logs=models.event_logs.filter(F.col("start_time") < F.lit(dt.datetime(day.year, day.month, 15))))
    JB.build_marts(fewer, wh, day, day)
    now = {str(r.month): r["count"] for r in JB.read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES, keep_month=True).groupBy("month").count().collect()}
    assert now[some] < full[some] and {m: n for m, n in now.items() if m != some} == {m: n for m, n in full.items() if m != some}


def test_calibration_csv(spark):
    out = fresh_dir(spark, "calib")
    path = JB.norm_calibration_run(spark, SF_SMALL, dt.datetime(2024, 1, 31), out)
    assert path.endswith("run_date=2024-01-31")
    rows = spark.read.option("header", True).csv(path).collect()
    assert len(rows) == 5 and "recommended_norm_sec" in rows[0].asDict()


def test_retention_drops_old_months(spark):
    from opsloss.sources.adapters import telemetry
    wh = JB.new_warehouse(spark)
    path = wh.path("raw", "scada_telemetry")
    tel = telemetry(spark, SF_SMALL)
    # three months: Dec 2023 (shifted copy), Jan 2024 (the data), Feb 2024 (shifted copy)
    shift = lambda months: tel.withColumn("ts", F.col("ts") + F.make_ym_interval(F.lit(0), F.lit(months)))
    ST.append(tel.unionByName(shift(-1)).unionByName(shift(1)), path, "scada_telemetry")
    assert ST.list_months(spark, path) == ["202312", "202401", "202402"]
    out = JB.apply_retention(spark, path, dt.datetime(2025, 1, 15, 12))
    assert out == {"dropped": ["202312"], "rewritten": ["202401"]}
    kept = JB.read_telemetry(spark, path)
    jan = kept.filter(F.col("month") == "202401")
    assert jan.filter(F.col("ts") <= F.lit(dt.datetime(2024, 1, 15, 12))).count() == 0
    assert 0 < jan.count() < 1000 and kept.filter(F.col("month") == "202402").count() == 1000
    n_kept = kept.count()
    again = JB.apply_retention(spark, path, dt.datetime(2025, 1, 15, 12))
    assert again["dropped"] == [] and JB.read_telemetry(spark, path).count() == n_kept
    JB.apply_retention(spark, path, dt.datetime(2026, 1, 1))
    assert JB.read_telemetry(spark, path).count() == 0


def test_weekly_run_empty_week_writes_nothing(spark):
    assert JB.weekly_run(spark, SF_SMALL, STAMP, D.sample_rows(spark), week_start=dt.date(2023, 6, 5)) == {}
    paths = JB.weekly_run(spark, SF_SMALL, STAMP, D.sample_rows(spark), week_start=dt.date(2024, 1, 8))
    (t,) = spark.read.parquet(paths["totals"]).collect()
    assert t.week_start == dt.date(2024, 1, 8) and t.total_events > 0
    assert {"pulse", "loss_table", "analysis", "prompts", "captions"} <= paths.keys()


def test_ingest_job_counts(spark):
    from opsloss.plans import requests as RQ
    from opsloss.sources.tables import table
    wh = JB.new_warehouse(spark)
    d = fresh_dir(spark, "req")
    RQ.write_event_requests(table(spark, SF_SMALL, "events"), d)
    out = JB.ingest_job(spark, d, wh)
    assert out["inserted"] == 800 and out["rejected_batches"] == 2       # of ten requests one is cut off, one empty
    r = fresh_dir(spark, "req_r")
    RQ.write_reading_requests(table(spark, SF_SMALL, "events"), r)
    out = JB.ingest_job(spark, r, wh, kind="readings")
    stored = JB.read_telemetry(spark, wh.path("raw", "scada_telemetry")).count()
    assert out["inserted"] == stored and out["rejected_batches"] > 2


def test_cli_rejects_bad_date():
    import pytest
    from opsloss.__main__ import main
    with pytest.raises(SystemExit) as e:
        main(["daily", "--sf-dir", SF_SMALL, "--norms", "n", "--rates", "r", "--date", "10.01.2024"])
    assert e.value.code == 1


def test_month_rewrite_and_pruning(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), "A", 1.0), (dt.date(2024, 2, 1), "A", 5.0)],
                                 "event_date date, operation_name string, total_loss double")
    wh = JB.new_warehouse(spark)
    ST.overwrite_partitions(rows, wh.mart_losses, "mart_daily_losses")
    ST.overwrite_partitions(rows.filter("total_loss = 1").withColumn("total_loss", F.lit(2.0)), wh.mart_losses, "mart_daily_losses")
    df = JB.read_mart(spark, wh.mart_losses, rows.schema, keep_month=True)
    assert sorted(r.total_loss for r in df.collect()) == [2.0, 5.0]
    df = ST.month_bound(df, since=dt.date(2024, 2, 1))
    assert [r.total_loss for r in df.collect()] == [5.0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_stored_facts_are_month_pruned(spark):
    from opsloss.operators import losses as L
    wh = JB.new_warehouse(spark)
    ST.append(Models(spark, SF_SMALL).event_logs, wh.path("raw", "event_logs"), "event_logs")
    facts = JB.read_event_logs(spark, wh.path("raw", "event_logs"))
    w = L.raw_window(facts, dt.datetime(2024, 1, 10))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "(month#" in plan and ">= 202401" in plan
    paths = JB.daily_run(spark, SF_SMALL, STAMP, D.sample_rows(spark), wh, report_date=dt.date(2024, 1, 10), stored_facts=True)
    ref = JB.daily_run(spark, SF_SMALL, STAMP, D.sample_rows(spark), report_date=dt.date(2024, 1, 10))
    cols = ["report_date", "total_loss", "total_events", "anomaly_count", "top_operation"]
    assert spark.read.parquet(paths["pulse"]).select(cols).collect() == \
        spark.read.parquet(ref["pulse"]).select(cols).collect()


def test_stored_mart_reads_prune_months(spark):
    from opsloss.operators import reports as Rp
    from opsloss.plans.models import Models
    from opsloss import schemas
    wh = JB.new_warehouse(spark)
    ST.overwrite_partitions(Models(spark, SF_SMALL, "lineitem").mart_daily_losses, wh.mart_losses,
                            "mart_daily_losses")
    mart = JB.read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES, keep_month=True)
    first = mart.filter(F.col("month") == "199806").agg(F.min("event_date")).first()[0]
    assert first is not None and first.strftime("%Y%m") == "199806"
    day = Rp.losses_from_mart(mart, first)
    week = Rp.weekly_losses_marts(mart, dt.date(1998, 6, 8))
    for df in (day, week):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(month" in plan and "199806" in plan
    assert day.count() > 0 and week.count() > 0


def test_daily_reports_as_csv(spark):
    paths = JB.daily_run(spark, SF_SMALL, STAMP, D.sample_rows(spark), report_date=dt.date(2024, 1, 10),
                         report_format="csv")
    rows = spark.read.option("header", True).csv(paths["analysis"]).collect()
    assert rows and rows[0].asDict().keys() >= {"report_date", "line_no", "line"}


def test_create_tables_keeps_existing_data(spark):
    from opsloss.plans.models import Models
    wh = JB.new_warehouse(spark)
    JB.create_tables(spark, wh)
    assert all(os.path.isdir(p) for p in (wh.dim_norms, wh.dim_rates, wh.mart_losses, wh.mart_health))
    assert JB.list_rates(spark, wh).count() == 0
    assert JB.read_telemetry(spark, wh.path("raw", "scada_telemetry")).count() == 0
    ST.append(Models(spark, SF_SMALL).telemetry, wh.path("raw", "scada_telemetry"), "scada_telemetry")
    JB.create_tables(spark, wh)                                   # a rerun must not clobber data
    assert JB.read_telemetry(spark, wh.path("raw", "scada_telemetry")).count() == 1000


def test_dims_from_files_lowered_norm_and_created_rows(spark):
    wh = JB.new_warehouse(spark)
    JB.create_tables(spark, wh)
    place = fresh_dir(spark, "dims_src")
    norms, rates = D.sample_rows(spark)
    norms.write.parquet(f"{place}/norms")
    rates.write.parquet(f"{place}/rates")
    n, r = D.read_source(spark, f"{place}/norms", f"{place}/rates")
    assert JB.sync_dims(n, r, wh, STAMP) == {"rates": 3, "norms": 9}
    assert JB.sync_dims(n.withColumn("norm_seconds", F.lit(7)), r, wh, STAMP + dt.timedelta(days=1)) == {"rates": 0, "norms": 9}
    assert JB.sync_dims(n.withColumn("norm_seconds", F.lit(7)), r, wh, STAMP + dt.timedelta(days=1)) == {"rates": 0, "norms": 0}
    assert JB.reduce_dim(spark, wh.dim_norms, schemas.NORMS_VERSIONED) == 9
    assert JB.read_dim(spark, wh.dim_norms, schemas.NORMS_VERSIONED).count() == 9
    assert {x.norm_seconds for x in JB.list_norms(spark, wh).collect()} == {7}
    at = STAMP + dt.timedelta(days=2)
    asked = spark.createDataFrame([(1, "picker", 1.0), (2, "driver", 2.0), (3, "driver", 3.0)],
                                  "request_seq long, role_name string, hourly_rate double")
    assert JB.create_rates(spark, asked, wh, at) == 1
    assert [(x.id, x.role_name, x.hourly_rate) for x in JB.list_rates(spark, wh).collect()][-1] == (4, "driver", 2.0)
    asked = spark.createDataFrame([(1, "pack", 60, 4), (2, "pack", 70, 4), (3, "lift", 5, 99), (4, "view", 1, 1)],
                                  "request_seq long, operation_name string, norm_seconds int, role_id int")
    assert JB.create_norms(spark, asked, wh, at) == 1
    last = JB.list_norms(spark, wh).collect()[-1]
    assert (last.id, last.operation_name, last.norm_seconds, last.role_id) == (10, "pack", 60, 4)


def test_failed_build_leaves_the_old_mart(spark, monkeypatch):
    """All new months are written, then publication fails: readers keep every row of the old version."""
    from opsloss.sources import snapshots as SN
    wh = JB.new_warehouse(spark)
    m = Models(spark, SF_SMALL, "lineitem")
    JB.build_marts(m, wh)
    before = JB.read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES)
    rows = sorted(map(tuple, before.collect()))
    fewer = Models(spark, SF_SMALL, "lineitem", event_logs=m.event_logs.filter("duration_seconds > 900"))
    with monkeypatch.context() as p:
        p.setattr(SN, "update", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        try:
            JB.build_marts(fewer, wh, dt.date(1996, 1, 1))
            raise AssertionError("must fail")
        except OSError:
            pass
    assert sorted(map(tuple, JB.read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES).collect())) == rows
    JB.build_marts(fewer, wh, dt.date(1996, 1, 1))
    now = JB.read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES)
    assert sorted(map(tuple, before.collect())) == rows              # a reader of the old version, after the new one is out
    early = lambda df: sorted(map(tuple, df.filter("event_date < DATE '1996-01-01'").collect()))
    assert early(now) == early(before) and now.count() < len(rows)
    # two complete versions stay; the data of the failed run goes
    assert SN.vacuum(spark, wh.mart_losses, keep=2, older_than=0)
    assert sorted(map(tuple, before.collect())) == rows


def test_publish_conflicts_and_broken_pointers(spark):
    import pytest
    from opsloss.sources import snapshots as SN
    root = fresh_dir(spark, "snap")
    rows = lambda x: spark.createDataFrame([(x,)], "x int")
    base = SN.current(spark, root)
    one = SN.publish(spark, root, base, SN.stage(rows(1), root))
    with pytest.raises(SN.Conflict):                                  # a writer that started from the same version
        SN.publish(spark, root, base, SN.stage(rows(2), root))
    with open(f"{root}/_pointers/{one.number + 1:08d}.json", "w") as f:     # a writer died in the middle
        f.write('{"parts": [{"pa')
    read = lambda: sorted(r.x for r in SN.read(spark, root, rows(0).schema).collect())
    assert read() == [1]
    SN.update(spark, root, lambda now: ((*now.parts, *SN.stage(rows(3), root)), None))
    assert read() == [1, 3]


def test_compaction_clusters_a_month(spark):
    """Many small files of a month become few, sorted by the key; rows are the same, and a key is in few files."""
    from opsloss.sources import snapshots as SN
    path = fresh_dir(spark, "facts")
    facts = Models(spark, SF_SMALL).event_logs
    for i in range(3):
        ST.append(facts.repartition(6).withColumn("user_id", F.lit(str(i))), path, "event_logs")
    before = JB.read_event_logs(spark, path)
    rows = sorted(map(str, before.collect()))
    done = ST.compact(spark, path, "event_logs", schemas.EVENT_LOGS, file_bytes=20_000)
    now = JB.read_event_logs(spark, path)
    assert done == {"202401": 18} and sorted(map(str, now.collect())) == rows
    assert len(SN.current(spark, path).parts) == 1 and len(now.inputFiles()) <= 8
    files = now.groupBy(F.input_file_name().alias("f")).agg(F.min("operation_name").alias("lo"), F.max("operation_name").alias("hi"))
    one = files.filter("lo <= 'click' and 'click' <= hi").count()      # files a filter on one operation must read
    assert one < files.count()
    assert ST.compact(spark, path, "event_logs", schemas.EVENT_LOGS, file_bytes=20_000) == {}
    assert sorted(map(str, before.collect())) == rows                  # readers of the old folders


def test_raw_report_of_every_date_equals_one_by_one(spark):
    from opsloss.operators import losses as L
    m = Models(spark, SF_SMALL)
    odd = m.event_logs.withColumn("start_time", F.when(F.col("operation_name") == "view", F.lit(dt.datetime(2024, 1, 5, 3)))
                                  .when(F.col("operation_name") == "error", F.lit(None)).otherwise(F.col("start_time")))
    got = L.daily_losses_raw_every_date(odd, m.dims).collect()
    for day in (dt.date(2024, 1, 2), dt.date(2024, 1, 6), dt.date(2024, 1, 7), dt.date(2024, 1, 31)):
        want = L.daily_losses_raw(odd, m.dims, dt.datetime.combine(day, dt.time())).collect()
        of = sorted((r.operation_name, r.event_count, r.avg_duration_sec, r.total_loss) for r in got if r.report_date == day)
        assert of == sorted((r.operation_name, r.event_count, r.avg_duration_sec, r.total_loss) for r in want)
    assert not any(r.operation_name == "view" and r.report_date > dt.date(2024, 1, 6) for r in got)


def test_stream_partials_are_added_once(spark, monkeypatch):
    """A micro-batch that fails after its data are written is repeated and counts once; partials are folded; the mart
    restates what changed only."""
    from opsloss.operators import histogram as H
    from opsloss.sources import snapshots as SN
    from opsloss.streaming import aggregates as SA
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src, out = fresh_dir(spark, "s_in"), fresh_dir(spark, "s_out")
    for part in range(3):
        ev.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(src)
        real, left = SN.publish, [1]

        def once(*a, **k):
            if left and part == 1:
                left.pop()
                raise OSError("lost")
            return real(*a, **k)

        monkeypatch.setattr(SN, "publish", once)
        try:
            SA.run_losses(A.events_to_event_logs(SA.file_stream(spark, src, ev.schema)), out, fold_at=1)
        except Exception:  # noqa: BLE001
            SA.run_losses(A.events_to_event_logs(SA.file_stream(spark, src, ev.schema)), out, fold_at=1)
        monkeypatch.setattr(SN, "publish", real)
    m = Models(spark, SF_SMALL)
    total = SA.histogram(spark, out).agg(F.sum("n")).first()[0]
    assert total == m.stg_events.count()
    assert len(SN.current(spark, f"{out}/partials").parts) == 1        # one month, folded
    first = SA.refresh_losses(spark, out, m.dims)
    want = sorted(map(str, m.mart_daily_losses.collect()))
    assert sorted(map(str, SA.losses_mart(spark, out).collect())) == want and first["keys"] >= len(want)
    assert SA.refresh_losses(spark, out, m.dims) == {"keys": 0, "months": 0}
    one = m.dims.withColumn("norm_seconds", F.when(F.col("operation_name") == "click", 1).otherwise(F.col("norm_seconds")).cast("int"))
    again = SA.refresh_losses(spark, out, one)
    assert 0 < again["keys"] < first["keys"]
    assert sorted(map(str, SA.losses_mart(spark, out).collect())) == sorted(map(str, H.mart_daily_losses(H.daily_histogram(m.stg_events), one).collect()))

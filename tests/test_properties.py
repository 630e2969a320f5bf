"""Randomised properties against plain-Python references (hypothesis)."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsloss import schemas as S
from opsloss.functions.rounding import round_n
from opsloss.operators import losses as L
from opsloss.operators import staging
from opsloss.operators.versioning import latest_by_key
from opsloss.sources import adapters as A

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=30),
       st.integers(min_value=0, max_value=4))
def test_round_n_is_decimal_half_up(spark, xs, n):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_n("x", n)).collect()]
    ref = [float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
                 .quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP)) for x in xs]
    assert got == ref


EVENTS = "case_id string, operation_name string, start_time timestamp_ntz, end_time timestamp_ntz, " \
         "duration_seconds int, user_id string"


@SETTINGS
@given(st.lists(st.integers(min_value=1, max_value=86399), min_size=1, max_size=40),
       st.integers(min_value=1, max_value=5000), st.sampled_from([450.0, 480.0, 520.0]))
def test_mart_loss_reference_and_bound(spark, durations, norm, rate):
    t = dt.datetime(2024, 1, 10, 9)
    ev = spark.createDataFrame([(f"c{i}", "A", t, t, d, "u") for i, d in enumerate(durations)], EVENTS)
    dims = spark.createDataFrame([("A", norm, 1, "r", rate)],
                                 "operation_name string, norm_seconds int, role_id int, role_name string, "
                                 "hourly_rate double")
    (m,) = L.mart_daily_losses(L.ops_enriched(staging.stg_event_logs(ev), dims)).collect()
    clipped = sum(max(d - norm, 0) for d in durations)
    assert m.event_count == len(durations)
    assert m.total_loss == float(Decimal(repr(clipped / 3600.0 * rate)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
                                 .quantize(Decimal("0.01"), ROUND_HALF_UP))
    (r,) = L.daily_losses_raw(ev, dims, dt.datetime(2024, 1, 10)).collect()
    assert m.total_loss >= r.total_loss - 0.01          # per-event clip never below clip of the mean (S1)


@SETTINGS
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 3), st.integers(0, 9)), min_size=1, max_size=40))
def test_latest_by_key_reference(spark, rows):
    base = dt.datetime(2024, 1, 1)
    data = [(k, v, base + dt.timedelta(days=day)) for k, v, day in rows]
    df = spark.createDataFrame(data, "id int, value int, updated_at timestamp_ntz")
    got = {r.id: r.value for r in latest_by_key(df, "id").collect()}
    ref = {}
    for k, v, ts in data:
        if k not in ref or (ts, v) > ref[k]:
            ref[k] = (ts, v)
    assert got == {k: v for k, (_, v) in ref.items()}


def test_totals_equal_sum_of_rounded_rows(spark):
    """S8 on real data: the report total is the rounded sum of the rounded row losses."""
    from opsloss.operators import reports as Rp
    from opsloss.plans.models import Models
    from tests.conftest import SF_SMALL
    losses = Rp.losses_from_mart(Models(spark, SF_SMALL, "lineitem").mart_daily_losses)
    tot = {r.report_date: r.total_loss for r in Rp.report_totals(losses).collect()}
    rows = losses.groupBy("report_date").agg(F.collect_list("total_loss").alias("l")).collect()
    for r in rows:
        ref = float(Decimal(repr(sum(r.l))).quantize(Decimal("1e-9"), ROUND_HALF_UP)
                    .quantize(Decimal("0.01"), ROUND_HALF_UP))
        assert abs(tot[r.report_date] - ref) <= 0.011


def test_stream_health_restart_equals_batch(spark):
    """J3 across two runs: a second file updates groups of the first; the
    latest batch per key must equal the batch mart over both files."""
    from opsloss.operators import equipment as E
    from opsloss.session import fresh_dir
    from opsloss.sources import snapshots as SN
    from opsloss.sources.adapters import events_to_telemetry
    from opsloss.streaming import aggregates as SA
    from opsloss.streaming import partials as P
    from tests.conftest import SF_SMALL

    src = fresh_dir(spark, "stream_src")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.write.mode("append").parquet(src)
    out = fresh_dir(spark, "stream_out")
    SA.run_health(A.events_to_telemetry(SA.file_stream(spark, src, ev.schema)), out)
    later = ev.withColumn("event_id", F.col("event_id") + 1_000_000) \
              .withColumn("value", F.col("value") + 1.0)                      # same days, new readings
    later.write.mode("append").parquet(src)
    SA.run_health(A.events_to_telemetry(SA.file_stream(spark, src, ev.schema)), out)
    both = E.mart_equipment_health(E.telemetry_daily_stats(staging.stg_telemetry(events_to_telemetry(ev.unionByName(later)))))
    a, b = (sorted(map(str, x.select(*both.columns).collect())) for x in (SA.health_mart(spark, out), both))
    assert a == b and len(a) > 0
    # folding partials and merging them again changes nothing
    P.fold(spark, f"{out}/partials", SA.merge_health, SA.HEALTH_PARTIAL, fold_at=1)
    assert len(SN.current(spark, f"{out}/partials").parts) == 1
    assert sorted(map(str, SA.health_mart(spark, out).select(*both.columns).collect())) == b


def test_merged_spread_does_not_cancel(spark):
    """Values far from zero with a small spread: sums of squares in doubles would lose it."""
    from opsloss.operators import equipment as E
    from opsloss.streaming import aggregates as SA
    import datetime as dt
    rows = [(dt.datetime(2024, 1, 1, i), "E", "n", "m", 1e9 + i % 3, "u", "running", "scada", 192) for i in range(24)]
    df = spark.createDataFrame(rows, S.TELEMETRY)
    parts = [SA.health_partial(df.filter(f"hour(ts) % 4 = {k}")) for k in range(4)]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    (m,) = SA.merge_health(both).collect()
    (want,) = E.telemetry_daily_stats(staging.stg_telemetry(df)).collect()
    assert abs((m.spread / m.reading_count) ** 0.5 - want.stddev_value) < 1e-6 and m.reading_count == 24


def test_stream_losses_restart_equals_batch(spark):
    from opsloss.plans.models import Models
    from opsloss.session import fresh_dir
    from opsloss.streaming import aggregates as SA
    from tests.conftest import SF_SMALL

    m = Models(spark, SF_SMALL)
    src = fresh_dir(spark, "stream_src_losses")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    later = ev.withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("value", F.col("value") * 1.5)
    out = fresh_dir(spark, "stream_out_losses")
    for part in (ev, later):
        part.write.mode("append").parquet(src)
        SA.run_losses(A.events_to_event_logs(SA.file_stream(spark, src, ev.schema)), out)
    SA.refresh_losses(spark, out, m.dims)
    from opsloss.sources.adapters import events_to_event_logs
    ref = L.mart_daily_losses(L.ops_enriched(staging.stg_event_logs(events_to_event_logs(ev.unionByName(later))),
                                             m.dims))
    a, b = (sorted(map(str, x.select(*ref.columns).collect())) for x in (SA.losses_mart(spark, out), ref))
    assert a == b and len(a) > 0

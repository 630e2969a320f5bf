"""Loss formulas: golden vectors, edge frames, and the two-formula property."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsloss.operators import losses as L
from opsloss.operators import staging

DIMS = "operation_name string, norm_seconds int, hourly_rate double, role_name string"
PER_OP = "operation_name string, event_count bigint, avg_duration_sec double, total_duration_sec bigint"
EVENTS = "case_id string, operation_name string, start_time timestamp_ntz, end_time timestamp_ntz, " \
         "duration_seconds int, user_id string"


@pytest.fixture()
def dims(spark):
    return spark.createDataFrame(
        [("A", 300, 450.0, "r1"), ("B", 180, 520.0, "r2"), ("C", 240, 480.0, "r3")], DIMS)


def test_golden_vectors(spark, dims):
    per_op = spark.createDataFrame(
        [("A", 100, 450.0, 45000), ("B", 80, 200.0, 16000), ("C", 60, 300.0, 18000)], PER_OP)
    rows = L.calculate_losses(per_op, dims).collect()
    assert [r.operation_name for r in rows] == ["A", "C", "B"]
    a, c, b = rows
    assert (a.delta_sec, round(a.loss_per_event, 2), a.total_loss) == (150.0, 18.75, 1875.0)
    assert (c.delta_sec, round(c.loss_per_event, 2), c.total_loss) == (60.0, 8.0, 480.0)
    assert (b.delta_sec, round(b.loss_per_event, 2), b.total_loss) == (20.0, 2.89, 231.11)
    assert (a.avg_duration_min, a.norm_min, b.avg_duration_min) == (7.5, 5.0, 3.33)
    assert round(sum(r.total_loss for r in rows), 2) == 2586.11
    assert sum(r.event_count for r in rows) == 240


def test_under_norm_is_zero(spark, dims):
    per_op = spark.createDataFrame([("A", 50, 200.0, 10000)], PER_OP)
    (r,) = L.calculate_losses(per_op, dims).collect()
    assert (r.delta_sec, r.total_loss) == (0.0, 0.0)


def test_single_event_formula(spark, dims):
    per_op = spark.createDataFrame([("A", 1, 660.0, 660)], PER_OP)
    (r,) = L.calculate_losses(per_op, dims).collect()
    assert r.total_loss == 45.0


def test_empty_and_unknown(spark, dims):
    assert L.calculate_losses(spark.createDataFrame([], PER_OP), dims).count() == 0
    unknown = spark.createDataFrame([("Z", 10, 999.0, 9990)], PER_OP)
    assert L.calculate_losses(unknown, dims).count() == 0


def _events(spark, durations, op="A", day=dt.datetime(2024, 1, 10, 8)):
    rows = [(f"c{i}", op, day, day, d, "u") for i, d in enumerate(durations)]
    return spark.createDataFrame(rows, EVENTS)


def test_staging_duration_edges(spark):
    ev = _events(spark, [0, -5, 1, 86399, 86400])
    kept = sorted(r.duration_seconds for r in staging.stg_event_logs(ev).collect())
    assert kept == [1, 86399]


def test_mart_clips_each_event_raw_clips_mean(spark, dims):
    # durations 100 and 500 against norm 300: mean 300 → raw loss 0, mart loss > 0
    ev = _events(spark, [100, 500])
    raw = L.daily_losses_raw(ev, dims, dt.datetime(2024, 1, 11)).collect()
    assert raw[0].total_loss == 0.0
    enriched = L.ops_enriched(staging.stg_event_logs(ev), dims.withColumn("role_id", F.lit(1)))
    (m,) = L.mart_daily_losses(enriched).collect()
    assert m.total_loss == round(200 / 3600 * 450, 2)
    assert m.delta_sec == 100.0            # mean of clipped deltas, not avg - norm (S7)
    assert m.z_score == 0.0                # (300 - 300) / 200


def test_z_score_guard_single_event(spark, dims):
    ev = _events(spark, [400])
    enriched = L.ops_enriched(staging.stg_event_logs(ev), dims.withColumn("role_id", F.lit(1)))
    (m,) = L.mart_daily_losses(enriched).collect()
    assert m.z_score == 0.0 and m.event_count == 1


def test_raw_window_has_no_upper_bound(spark, dims):
    ev = _events(spark, [400], day=dt.datetime(2024, 1, 20))
    assert L.daily_losses_raw(ev, dims, dt.datetime(2024, 1, 11)).count() == 1
    assert L.daily_losses_raw(ev, dims, dt.datetime(2024, 1, 11), bounded=True).count() == 0


def test_mart_not_below_raw_on_same_rows(spark):
    """Property (S1): per-event clipping never gives less than clipping the mean."""
    from opsloss.plans.models import Models
    from tests.conftest import SF_SMALL

    m = Models(spark, SF_SMALL)
    stg = m.stg_events
    mart = L.mart_daily_losses(L.ops_enriched(stg, m.dims))
    raw = L.calculate_losses(L.aggregate_per_operation(stg, "event_date"), m.dims)
    j = mart.alias("m").join(raw.alias("r"), ["event_date", "operation_name"])
    bad = j.filter(F.col("m.total_loss") < F.col("r.total_loss") - F.lit(0.011)).count()
    assert j.count() > 0 and bad == 0


def test_mart_is_permutation_invariant(spark):
    from opsloss.plans.models import Models
    from tests.conftest import SF_SMALL

    m = Models(spark, SF_SMALL)
    a = L.mart_daily_losses(L.ops_enriched(m.stg_events, m.dims))
    shuffled = m.stg_events.repartition(7, "case_id").orderBy(F.rand(3))
    b = L.mart_daily_losses(L.ops_enriched(shuffled, m.dims))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0

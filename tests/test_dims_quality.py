"""Dimension versioning, dimension load checks and data-quality checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsloss.operators import joins as J
from opsloss.operators import quality as Q
from opsloss.operators import staging
from opsloss.operators import versioning as V

NORMS_V = "id int, operation_name string, norm_seconds int, role_id int, updated_at timestamp_ntz"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def test_latest_by_key_versions_and_ties(spark):
    df = spark.createDataFrame([
        (1, "A", 100, 1, T1), (1, "A", 150, 1, T2),       # newer version wins
        (2, "B", 200, 1, T2), (2, "B", 250, 1, T2),       # tie: larger payload wins
        (3, "C", 300, 2, T1),
    ], NORMS_V)
    got = {r.norm_id: r.norm_seconds for r in staging.stg_norms(df).collect()}
    assert got == {1: 150, 2: 250, 3: 300}


def test_resync_is_idempotent_and_keeps_deleted(spark):
    src = spark.createDataFrame([(1, "A", 100, 1), (2, "B", 200, 1)], "id int, operation_name string, "
                                "norm_seconds int, role_id int")
    log1 = V.stamp_snapshot(src, T1)
    once = V.latest_by_key(log1, "id")
    twice = V.latest_by_key(log1.unionByName(V.stamp_snapshot(src, T2)), "id")
    assert sorted(once.collect()) == sorted(twice.collect())
    deleted = log1.unionByName(V.stamp_snapshot(src.filter("id = 1"), T2))   # id 2 removed at source
    assert V.latest_by_key(deleted, "id").count() == 2                        # S17: deletes never propagate


def test_fk_split_and_new_rows(spark):
    roles = spark.createDataFrame([(1, "r1"), (2, "r2")], "id int, role_name string")
    norms = spark.createDataFrame([(10, "A", 1), (11, "B", 9)], "id int, operation_name string, role_id int")
    ok, bad = J.accept_with_parent(norms, roles, "role_id", "id")
    assert [r.id for r in ok.collect()] == [10] and [r.id for r in bad.collect()] == [11]
    incoming = spark.createDataFrame([(1, "r2", 1.0), (2, "r3", 2.0), (3, "r3", 3.0)],
                                     "seq long, role_name string, hourly_rate double")
    (new,) = J.new_rows_only(incoming, roles, "role_name", "seq").collect()
    assert (new.role_name, new.hourly_rate) == ("r3", 2.0)


def test_sized_broadcast_falls_back(spark):
    small = spark.range(5)
    big = spark.range(50)
    j1 = spark.range(100).join(J.sized_broadcast(small, 100), "id")
    j2 = spark.range(100).join(J.sized_broadcast(big, 100), "id")
    assert j1.count() == 5 and j2.count() == 50
    plan_small = j1._jdf.queryExecution().optimizedPlan().toString()
    plan_big = j2._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan_small.lower() and "strategy=broadcast" not in plan_big.lower()


TEL = "ts timestamp_ntz, equipment_id string, equipment_name string, metric_name string, metric_value double, " \
      "unit string, equipment_state string, source_system string, quality smallint"


def test_telemetry_filter_and_health_flags(spark):
    from opsloss.operators import equipment as E
    t = dt.datetime(2024, 1, 5, 10)
    rows = [(t, "EQ", "n", "m", 1.0, "u", s, "scada", q) for s, q in
            [("running", 0), ("running", 63), ("warning", 64), ("idle", 128), ("error", 192), ("off", 192)]]
    rows.append((t, "EQ", "n", "m", None, "u", "maintenance", "scada", 192))
    stg = staging.stg_telemetry(spark.createDataFrame(rows, TEL))
    assert stg.count() == 4
    (h,) = E.mart_equipment_health(E.telemetry_daily_stats(stg)).collect()
    assert (h.warning_count, h.maintenance_count, h.idle_count, h.has_issues) == (1, 0, 1, 1)


def test_quality_checks_catch_defects(spark):
    t = dt.datetime(2024, 1, 5, 10)
    rows = [(t, "EQ", "name-1", "m", 1.0, "u", "bogus", "scada", 192),
            (t, "EQ", "name-2", "m", 2.0, "u", "running", "scada", 192),     # renamed within a day
            (t, None, "n", "m", 3.0, "u", "running", "scada", 192)]
    stg = staging.stg_telemetry(spark.createDataFrame(rows, TEL))
    from opsloss.operators import equipment as E
    health = E.mart_equipment_health(E.telemetry_daily_stats(stg))
    assert [r.value for r in Q.unaccepted_values(stg, "equipment_state").collect()] == ["bogus"]
    (nn,) = Q.null_counts(stg, "stg", ["equipment_id"]).collect()
    assert nn.null_count == 1
    (dup,) = Q.duplicate_summary(health, "h", ["equipment_id", "metric_name", "reading_date"]).collect()
    assert (dup.duplicate_keys, dup.duplicate_rows) == (1, 2)
    summary = Q.dq_summary({"stg_telemetry": stg, "mart_equipment_health": health})
    with pytest.raises(Q.QualityGateError):
        Q.gate(Q.verdict(summary))


def test_gate_passes_on_clean_data(spark):
    from opsloss.plans.models import Models
    from tests.conftest import SF_SMALL
    Q.gate(Q.verdict(Q.dq_summary(Models(spark, SF_SMALL).quality_models())))


def test_negative_loss_and_duration_checks(spark):
    mart = spark.createDataFrame([(dt.date(2024, 1, 1), "A", -1.0)], "event_date date, operation_name string, "
                                 "total_loss double")
    assert Q.negative_losses(mart).count() == 1
    ev = spark.createDataFrame([("c", 0), ("d", 5)], "case_id string, duration_seconds int")
    assert [r.case_id for r in Q.durations_out_of_range(ev).collect()] == ["c"]


def test_fused_summary_equals_plain_summary(spark):
    from opsloss.plans.models import Models
    from tests.conftest import SF_SMALL
    m = Models(spark, SF_SMALL, "lineitem")
    a = Q.dq_summary(m.quality_models())
    b = m.dq_summary()
    assert sorted(a.collect()) == sorted(b.collect())


def test_fused_summary_counts_defects(spark):
    ev = spark.createDataFrame([("c1", "A", dt.date(2024, 1, 1), 5), (None, "A", dt.date(2024, 1, 1), 7),
                                (None, "Z", dt.date(2024, 1, 1), 7)],
                               "case_id string, operation_name string, event_date date, duration_seconds int")
    dims = spark.createDataFrame([("A", 10, "r", None), ("A", 12, "r", 3.0)],
                                 "operation_name string, norm_seconds int, role_name string, hourly_rate double")
    enriched = ev.join(dims, "operation_name")
    empty_n = spark.createDataFrame([], "norm_id int, operation_name string, norm_seconds int")
    empty_r = spark.createDataFrame([], "tariff_id int, role_name string, hourly_rate double")
    tel = spark.createDataFrame([], TEL).withColumn("reading_date", F.to_date("ts"))
    fused = {(r.model, r.column_name): r.failures for r in Q.dq_summary_fused(ev, dims, empty_n, empty_r, tel).collect()}
    assert fused[("stg_event_logs", "case_id")] == 2                # staged rows count once, with or without a norm
    assert fused[("mart_daily_losses", "operation_name::event_date")] == 1     # two norms: two rows under one key
    plain = {(r.model, r.column_name): r.failures for r in
             Q.null_counts(enriched, "int_operations_enriched",
                           ["case_id", "operation_name", "event_date", "norm_seconds", "hourly_rate"])
             .select("model", "column_name", F.col("null_count").alias("failures")).collect()}
    for k, v in plain.items():
        assert fused[k] == v
    assert fused[("int_operations_enriched", "case_id")] == 2       # duplicate dim rows count twice
    assert fused[("int_operations_enriched", "hourly_rate")] == 2
    assert fused[("stg_event_logs", "case_id")] == 2


def test_assign_ids_dense_at_every_size(spark):
    existing = spark.createDataFrame([(3, "r1"), (7, "r2")], "id int, role_name string")
    new = spark.createDataFrame([(20, "b"), (10, "a"), (30, "c")], "seq long, role_name string")
    got = sorted((r.id, r.role_name) for r in J.assign_ids(new, existing, "id", "seq").collect())
    assert got == [(8, "a"), (9, "b"), (10, "c")]
    many = spark.range(300_000).select((F.lit(300_000) - F.col("id")).alias("seq"))
    ids = J.assign_ids(many, existing, "id", "seq")
    assert ids.filter(F.col("id") != F.col("seq") + 7).count() == 0 and ids.count() == 300_000
    assert J.assign_ids(new.limit(0), existing, "id", "seq").count() == 0


def test_a_changed_dimension_is_read_anew(spark):
    from opsloss.session import fresh_dir
    path = fresh_dir(spark, "dim_changing")
    cols = "operation_name string, norm_seconds int"
    spark.createDataFrame([("A", 1)], cols).write.parquet(path)
    facts = spark.createDataFrame([("A",), ("B",)], "operation_name string")
    joined = lambda: facts.join(J.sized_broadcast(spark.read.parquet(path)), "operation_name").count()
    assert joined() == 1
    spark.createDataFrame([("B", 2)], cols).write.mode("append").parquet(path)
    assert joined() == 2
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_rounding_keeps_non_finite_and_large(spark):
    from opsloss.functions.rounding import round_n
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e16,), (1e300,), (None,), (1.2345,)], "x double")
    got = [r[0] for r in rows.select(round_n("x", 3)).collect()]
    assert got[0] != got[0] and got[1:] == [float("inf"), 1e16, 1e300, None, 1.235]


def test_observed_checks_equal_the_plain_summary(spark):
    """Facts with defects: what the mart writes observe is what each check counts by itself."""
    from opsloss.plans import jobs as JB
    from opsloss.plans.models import Models
    from opsloss import schemas
    from tests.conftest import SF_SMALL
    m = Models(spark, SF_SMALL)
    ev = m.event_logs.withColumn("case_id", F.when(F.col("duration_seconds") % 5 != 0, F.col("case_id")))
    tel = m.telemetry.withColumn("equipment_state", F.when(F.col("equipment_id") != "EQ-001", F.col("equipment_state")).otherwise(F.lit("lost")))
    broken = Models(spark, SF_SMALL, event_logs=ev, telemetry=tel)
    wh, checks = JB.new_warehouse(spark), Q.WriteChecks()
    JB.build_marts(broken, wh, watch=checks.watch)
    got = checks.summary(broken.stg_norms, broken.stg_rates, JB.read_mart(spark, wh.mart_losses, schemas.MART_DAILY_LOSSES),
                         JB.read_mart(spark, wh.mart_health, schemas.MART_EQUIPMENT_HEALTH))
    want = sorted(map(tuple, Q.dq_summary(broken.quality_models()).collect()))
    assert sorted(map(tuple, got.collect())) == want == sorted(map(tuple, broken.dq_summary().collect()))
    assert sum(r[3] > 0 for r in want) == 3


def test_daily_run_reads_each_fact_once(spark):
    """Rows that pass a counter on their way out of the fact tables, over a whole daily job with its checks and reports."""
    from opsloss.plans import jobs as JB
    from opsloss.plans.models import Models
    from opsloss.sources import dims as D
    from tests.conftest import SF_SMALL
    m = Models(spark, SF_SMALL)

    def counted(facts):
        seen = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return facts.mapInArrow(run, facts.schema), seen

    (ev, n_ev), (tel, n_tel) = counted(m.event_logs), counted(m.telemetry)
    JB.daily_run(spark, SF_SMALL, dt.datetime(2024, 2, 1), D.sample_rows(spark), facts=(ev, tel))
    assert (n_ev.value, n_tel.value) == (1000, 1000)


def test_fused_summary_scans_each_fact_once(spark):
    from opsloss.plans.models import Models
    from tests.conftest import SF_SMALL
    for name, frame in (("all", Models(spark, SF_SMALL).dq_summary()),):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2, name          # events as event log, events as telemetry

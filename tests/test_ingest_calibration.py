"""Batch validation and defaults (A1-A4), calibration edge cases."""

import datetime as dt
import json
import os

from opsloss import schemas as S
from opsloss.operators import calibration as C
from opsloss.session import fresh_dir
from opsloss.sources import ingest as I

EVENT = {"case_id": "c1", "operation_name": "A", "start_time": "2024-01-01T10:00:00.000000",
         "end_time": "2024-01-01T10:05:00.000000", "duration_seconds": 300, "user_id": "u1"}
READING = {"ts": "2024-01-01T10:00:00.000000", "equipment_id": "EQ", "metric_name": "m", "metric_value": 1.5}


def _write(spark, lines):
    d = fresh_dir(spark, "test_batches")
    os.makedirs(d, exist_ok=True)
    with open(os.path.join(d, "part.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    return d


def test_event_batches(spark):
    d = _write(spark, [
        json.dumps({"batch_id": 1, "rows": [EVENT]}),
        json.dumps({"batch_id": 2, "rows": []}),
        json.dumps({"batch_id": 3, "rows": [EVENT, {k: v for k, v in EVENT.items() if k != "user_id"}]}),
        json.dumps({"batch_id": 4, "rows": [dict(EVENT, duration_seconds="abc")]}),
        "not json at all",
    ])
    v = I.validated(I.read_lines(spark, d), "events").cache()
    acc = I.accepted(v, "events").collect()
    assert len(acc) == 1 and acc[0].duration_seconds == 300 and acc[0].start_time == dt.datetime(2024, 1, 1, 10)
    reasons = {(r.batch_id, r.reject_reason) for r in I.rejected(v, "events").collect()}
    assert (2, "empty") in reasons and (3, "missing_required") in reasons
    assert sum(1 for _, why in reasons if why == "corrupt") == 2
    rep = {r.batch_id: r.inserted for r in I.ingest_report(v, "events").collect() if r.batch_id}
    assert rep[1] == 1 and rep[2] == 0


def test_reading_defaults(spark):
    d = _write(spark, [json.dumps({"batch_id": 1, "readings": [READING, dict(READING, quality=64, unit="bar")]})])
    v = I.validated(I.read_lines(spark, d), "readings")
    rows = sorted(I.accepted(v, "readings").collect(), key=lambda r: r.quality)
    assert (rows[0].quality, rows[0].unit) == (64, "bar")
    r = rows[1]
    assert (r.equipment_name, r.unit, r.equipment_state, r.source_system, r.quality) == ("", "", "running", "scada", 192)


EV = "case_id string, operation_name string, start_time timestamp_ntz, end_time timestamp_ntz, " \
     "duration_seconds int, user_id string"


def test_calibration_edges(spark):
    t = dt.datetime(2024, 1, 20)
    ev = spark.createDataFrame([("c", "solo", t, t, 100, "u"),
                                ("c", "Z", t, t, 100, "u"), ("c", "Z", t, t, 200, "u"),
                                ("c", "N", t, t, 10, "u"), ("c", "N", t, t, 20, "u"),
                                ("c", "old", dt.datetime(2023, 1, 1), t, 10, "u")], EV)
    norms = spark.createDataFrame([(1, "Z", 0, 1), (2, "solo", 50, 1)],
                                  "norm_id int, operation_name string, norm_seconds int, role_id int")
    stats = C.calibration_stats(C.calibration_window(ev, dt.datetime(2024, 1, 31)))
    got = {r.operation_name: r for r in C.norm_calibration(stats, norms).collect()}
    assert set(got) == {"solo", "Z", "N"}                              # lookback drops "old"
    assert got["solo"].std_sec is None and got["solo"].recommended_norm_sec is None   # S22
    assert got["Z"].delta_pct is None and got["Z"].current_norm_sec == 0              # S23: norm 0
    assert got["N"].current_norm_sec is None and got["N"].delta_sec is None           # no norm
    z = got["Z"]
    assert (z.median_sec, z.std_sec, z.p75_sec, z.recommended_norm_sec) == (150.0, 70.7, 175.0, 185)


def test_recommendation_rounds_half_even(spark):
    from opsloss.functions.expressions import recommended_norm
    df = spark.createDataFrame([(10.0, 1.0), (11.0, 1.0)], "m double, s double")
    assert [r[0] for r in df.select(recommended_norm("m", "s")).collect()] == [10, 12]


def test_null_is_not_missing(spark):
    """An optional field may be missing, not null; in a required field either is a missing value."""
    d = _write(spark, [
        json.dumps({"batch_id": 1, "readings": [READING]}),
        json.dumps({"batch_id": 2, "readings": [READING, dict(READING, unit=None)]}),
        json.dumps({"batch_id": 3, "readings": [dict(READING, quality=None)]}),
        json.dumps({"batch_id": 4, "readings": [dict(READING, metric_value=None)]}),
        json.dumps({"batch_id": 5, "readings": [dict(READING, unit="null", equipment_name="\"unit\": null")]}),
        json.dumps({"batch_id": 6, "readings": None}),
        json.dumps({"batch_id": 7, "readings": [dict(READING, note=None)]}),
        json.dumps({"batch_id": 8, "readings": [dict(READING, unit={"unit": None})]}),
        "", "   ",
    ])
    v = I.validated(I.read_lines(spark, d), "readings")
    reasons = {r.batch_id: r.reject_reason for r in v.collect()}
    assert {k: x for k, x in reasons.items() if k != 8} == {
        1: None, 2: "null_value", 3: "null_value", 4: "missing_required", 5: None, 6: "empty", 7: None}
    assert I.accepted(v, "readings").filter("unit = 'null'").count() == 1


def test_ingest_job_takes_each_file_once(spark, monkeypatch):
    from opsloss.plans import jobs as JB
    from opsloss.sources import snapshots as SN
    wh = JB.new_warehouse(spark)
    d = _write(spark, [json.dumps({"batch_id": 1, "rows": [EVENT, EVENT]}), json.dumps({"batch_id": 2, "rows": []}), "cut off {"])
    root = wh.path("raw", "event_logs")
    with monkeypatch.context() as m:                                  # fails when all data are written
        m.setattr(SN, "publish", lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
        for _ in range(2):
            try:
                JB.ingest_job(spark, d, wh)
                raise AssertionError("must fail")
            except OSError:
                pass
    assert JB.read_event_logs(spark, root).count() == 0 and JB.ingest_rejects(spark, wh).count() == 0
    assert JB.ingest_job(spark, d, wh) == {"inserted": 2, "rejected_batches": 2, "files": 1}
    assert JB.ingest_job(spark, d, wh) == {"inserted": 0, "rejected_batches": 0, "files": 0}
    with open(os.path.join(d, "part2.json"), "w") as f:
        f.write(json.dumps({"batch_id": 3, "rows": [dict(EVENT, start_time="2024-03-01T10:00:00.000000")]}) + "\n")
    assert JB.ingest_job(spark, d, wh) == {"inserted": 1, "rejected_batches": 0, "files": 1}
    rows = JB.read_event_logs(spark, root)
    assert sorted(str(r.month) for r in rows.collect()) == ["202401", "202401", "202403"]
    assert {(r.batch_id, r.reject_reason, r.row_count) for r in JB.ingest_rejects(spark, wh).collect()} == {(2, "empty", 0), (None, "corrupt", 0)}
    # what the broken runs wrote is named by no pointer, and vacuum removes it
    assert len(SN.vacuum(spark, root, keep=1, older_than=0)) == 4 and JB.read_event_logs(spark, root).count() == 3


def test_ingest_job_parses_once(spark):
    """One job reads the requests: rows, rejects and counts come from the same write."""
    from opsloss.plans import jobs as JB
    wh = JB.new_warehouse(spark)
    d = _write(spark, [json.dumps({"batch_id": i, "rows": [EVENT] * (i % 3)}) for i in range(30)])
    seen = []
    real = I.read_lines
    try:
        I.read_lines = lambda *a: seen.append(a) or real(*a)
        out = JB.ingest_job(spark, d, wh)
    finally:
        I.read_lines = real
    assert len(seen) == 1 and out == {"inserted": 30, "rejected_batches": 10, "files": 1}


def test_stream_ingest_single_pass_and_restart(spark):
    from opsloss.streaming import ingest as SI
    d = _write(spark, [json.dumps({"batch_id": 1, "batch_part": 0, "rows": [EVENT]}),
                       json.dumps({"batch_id": 2, "batch_part": 0, "rows": []}),
                       "garbage"])
    out = fresh_dir(spark, "stream_ingest_test")
    root, n = SI.stream_ingest(spark, d, out, "events")
    assert n == {"batches": 1, "inserted": 1, "rejected_batches": 2}
    assert SI.ingested_rows(spark, root).count() == 1
    assert {r.reject_reason for r in SI.ingested_rejects(spark, root).collect()} == {"empty", "corrupt"}
    with open(os.path.join(d, "part2.json"), "w") as f:                 # a new request arrives
        f.write(json.dumps({"batch_id": 3, "batch_part": 0, "rows": [EVENT, EVENT]}) + "\n")
    _, n = SI.stream_ingest(spark, d, out, "events")                    # restart from the checkpoint
    assert (n["inserted"], n["rejected_batches"]) == (2, 0)
    assert SI.ingested_rows(spark, root).count() == 3                  # old files not re-ingested

"""Explicit schemas of the domain tables and request batches (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
TS, DT = T.TimestampNTZType(), T.DateType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


EVENT_LOGS = _struct(
    ("case_id", S), ("operation_name", S), ("start_time", TS),
    ("end_time", TS), ("duration_seconds", I), ("user_id", S),
)

TELEMETRY = _struct(
    ("ts", TS), ("equipment_id", S), ("equipment_name", S), ("metric_name", S),
    ("metric_value", D), ("unit", S), ("equipment_state", S),
    ("source_system", S), ("quality", T.ShortType()),
)

RATES = _struct(("id", I), ("role_name", S), ("hourly_rate", D))
NORMS = _struct(("id", I), ("operation_name", S), ("norm_seconds", I), ("role_id", I))
RATES_VERSIONED = _struct(*[(f.name, f.dataType) for f in RATES.fields], ("updated_at", TS))
NORMS_VERSIONED = _struct(*[(f.name, f.dataType) for f in NORMS.fields], ("updated_at", TS))

MART_DAILY_LOSSES = _struct(
    ("event_date", DT), ("operation_name", S), ("role_name", S), ("event_count", L),
    ("avg_duration_sec", D), ("norm_seconds", I), ("hourly_rate", D),
    ("delta_sec", D), ("total_loss", D), ("z_score", D),
)

MART_EQUIPMENT_HEALTH = _struct(
    ("reading_date", DT), ("equipment_id", S), ("equipment_name", S),
    ("metric_name", S), ("unit", S), ("reading_count", L), ("avg_value", D),
    ("min_value", D), ("max_value", D), ("stddev_value", D),
    ("warning_count", L), ("maintenance_count", L), ("idle_count", L),
    ("has_issues", I),
)

# Request batches as JSON lines: {"rows": [...]} and {"readings": [...]}.
# Timestamps arrive as ISO strings and are parsed by the reader.
EVENT_ROW = _struct(
    ("case_id", S), ("operation_name", S), ("start_time", TS),
    ("end_time", TS), ("duration_seconds", I), ("user_id", S),
)
READING = _struct(
    ("ts", TS), ("equipment_id", S), ("equipment_name", S), ("metric_name", S),
    ("metric_value", D), ("unit", S), ("equipment_state", S),
    ("source_system", S), ("quality", I),
)
CORRUPT = "_corrupt_record"
EVENT_BATCH = _struct(("batch_id", L), ("batch_part", L), ("rows", T.ArrayType(EVENT_ROW)), (CORRUPT, S))
READING_BATCH = _struct(("batch_id", L), ("batch_part", L), ("readings", T.ArrayType(READING)), (CORRUPT, S))

# Defaults of optional reading fields and required fields of
# each request row (they must equal the reference's request models).
READING_DEFAULTS = {
    "equipment_name": "",
    "unit": "",
    "equipment_state": "running",
    "source_system": "scada",
    "quality": 192,
}
EVENT_REQUIRED = ["case_id", "operation_name", "start_time", "end_time", "duration_seconds", "user_id"]
READING_REQUIRED = ["ts", "equipment_id", "metric_name", "metric_value"]

# The accepted equipment states.
EQUIPMENT_STATES = ["running", "idle", "warning", "maintenance", "error", "off"]

"""Independent SQL formulations of the registered queries (DuckDB dialect).

Written from the semantics, not generated from the Spark plans. The same
fixed dimension rows are inlined as ``VALUES``. Rounding uses the decimal
form of ``functions.rounding.round_n``; every sum/count is cast to BIGINT so
both engines report the same types.
"""

from __future__ import annotations

from ..functions.rounding import sql_round_n as R
from ..sources import dims

CASE_W, USER_W = 12, 9


def with_(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{final}"


def minutes(expr: str) -> str:
    return R(f"cast({expr} as double) / 60.0::double", 2)


# ---------------------------------------------------------------- sources

EVENT_LOGS = {
    "events": f"""
  SELECT 'CASE-' || lpad(cast(event_id as varchar), cast(greatest({CASE_W}, length(cast(event_id as varchar))) as integer), '0') AS case_id,
         event_type AS operation_name,
         ts AS start_time,
         ts + to_seconds(cast(floor((value - 0.5::double) * 200.0::double) as integer)) AS end_time,
         cast(floor((value - 0.5::double) * 200.0::double) as integer) AS duration_seconds,
         'USER-' || lpad(cast(user_id as varchar), cast(greatest({USER_W}, length(cast(user_id as varchar))) as integer), '0') AS user_id
  FROM events""",
    "lineitem": f"""
  SELECT 'CASE-' || lpad(cast(l_orderkey as varchar), cast(greatest({CASE_W}, length(cast(l_orderkey as varchar))) as integer), '0') AS case_id,
         l_returnflag || l_linestatus AS operation_name,
         l_shipdate AS start_time,
         l_shipdate + to_seconds(cast(l_quantity * 60.0::double as integer)) AS end_time,
         cast(l_quantity * 60.0::double as integer) AS duration_seconds,
         'USER-' || lpad(cast(l_suppkey as varchar), cast(greatest({USER_W}, length(cast(l_suppkey as varchar))) as integer), '0') AS user_id
  FROM lineitem""",
}

TELEMETRY = """
  SELECT ts,
         'EQ-' || lpad(cast(user_id % 20 as varchar), cast(greatest(3, length(cast(user_id % 20 as varchar))) as integer), '0') AS equipment_id,
         'Device ' || cast(user_id % 20 as varchar) AS equipment_name,
         event_type AS metric_name,
         CASE WHEN k = 50 THEN NULL ELSE value END AS metric_value,
         CASE event_type WHEN 'view' THEN 'rpm' WHEN 'click' THEN 'bar' WHEN 'error' THEN 'C'
                         WHEN 'purchase' THEN 'kW' WHEN 'signup' THEN 'mm/s' ELSE '' END AS unit,
         (['running', 'running', 'running', 'idle', 'warning', 'maintenance', 'error', 'off'])[k % 8 + 1]
           AS equipment_state,
         'scada' AS source_system,
         cast(CASE k % 20 WHEN 0 THEN 0 WHEN 1 THEN 64 WHEN 2 THEN 128 ELSE 192 END as smallint) AS quality
  FROM (SELECT *, cast(json_extract_string(props, '$.k') as integer) AS k FROM events)"""

STG_NORMS = f"""
  SELECT id AS norm_id, operation_name, norm_seconds, role_id FROM (
    SELECT *, row_number() OVER (PARTITION BY id
             ORDER BY updated_at DESC, operation_name DESC, norm_seconds DESC, role_id DESC) AS rn
    FROM {dims.norms_versioned_sql()}) WHERE rn = 1"""

STG_RATES = f"""
  SELECT id AS tariff_id, role_name, hourly_rate FROM (
    SELECT *, row_number() OVER (PARTITION BY id
             ORDER BY updated_at DESC, role_name DESC, hourly_rate DESC) AS rn
    FROM {dims.rates_versioned_sql()}) WHERE rn = 1"""

DIMS = """
  SELECT n.operation_name, n.norm_seconds, n.role_id, r.role_name, r.hourly_rate
  FROM stg_norms n JOIN stg_rates r ON n.role_id = r.tariff_id"""

STG_EVENTS = """
  SELECT case_id, operation_name, start_time, end_time, duration_seconds, user_id,
         cast(start_time as date) AS event_date
  FROM event_logs WHERE duration_seconds > 0 AND duration_seconds < 86400"""

STG_TELEMETRY = """
  SELECT ts, equipment_id, equipment_name, metric_name, metric_value, unit, equipment_state,
         source_system, quality, cast(ts as date) AS reading_date
  FROM telemetry WHERE quality >= 64 AND metric_value IS NOT NULL"""

ENRICHED = """
  SELECT e.case_id, e.operation_name, e.event_date, e.start_time, e.end_time, e.duration_seconds,
         e.user_id, d.norm_seconds, d.role_id, d.role_name, d.hourly_rate,
         greatest(cast(e.duration_seconds as double) - cast(d.norm_seconds as double), 0.0::double) AS delta_sec,
         greatest(cast(e.duration_seconds as double) - cast(d.norm_seconds as double), 0.0::double)
           / 3600.0::double * d.hourly_rate AS loss
  FROM stg_events e JOIN dims d ON e.operation_name = d.operation_name"""

MART = f"""
  SELECT event_date, operation_name, role_name, cast(count(*) as bigint) AS event_count,
         {R('avg(duration_seconds)', 2)} AS avg_duration_sec,
         norm_seconds, hourly_rate,
         {R('avg(delta_sec)', 2)} AS delta_sec,
         {R('sum(loss)', 2)} AS total_loss,
         {R('CASE WHEN stddev_pop(duration_seconds) > 0 THEN (avg(duration_seconds) - cast(norm_seconds as double)) / stddev_pop(duration_seconds) ELSE 0.0 END', 3)} AS z_score
  FROM enriched
  GROUP BY event_date, operation_name, role_name, hourly_rate, norm_seconds"""

STATS = """
  SELECT reading_date, equipment_id, equipment_name, metric_name, unit,
         cast(count(*) as bigint) AS reading_count,
         avg(metric_value) AS avg_value, min(metric_value) AS min_value, max(metric_value) AS max_value,
         stddev_pop(metric_value) AS stddev_value,
         cast(count(*) FILTER (WHERE equipment_state = 'warning') as bigint) AS warning_count,
         cast(count(*) FILTER (WHERE equipment_state = 'maintenance') as bigint) AS maintenance_count,
         cast(count(*) FILTER (WHERE equipment_state = 'idle') as bigint) AS idle_count
  FROM stg_telemetry
  GROUP BY reading_date, equipment_id, equipment_name, metric_name, unit"""

HEALTH = f"""
  SELECT reading_date, equipment_id, equipment_name, metric_name, unit, reading_count,
         {R('avg_value', 3)} AS avg_value, {R('min_value', 3)} AS min_value,
         {R('max_value', 3)} AS max_value, {R('stddev_value', 3)} AS stddev_value,
         warning_count, maintenance_count, idle_count,
         CASE WHEN warning_count + maintenance_count > 0 THEN 1 ELSE 0 END AS has_issues
  FROM stats"""


def base_ctes(source: str = "events", upto: str = "mart") -> list[tuple[str, str]]:
    """The model chain as CTEs, cut after ``upto``."""
    order = [
        ("event_logs", EVENT_LOGS[source]),
        ("stg_norms", STG_NORMS),
        ("stg_rates", STG_RATES),
        ("dims", DIMS),
        ("stg_events", STG_EVENTS),
        ("enriched", ENRICHED),
        ("mart", MART),
    ]
    names = [n for n, _ in order]
    return order[: names.index(upto) + 1]


def telemetry_ctes(upto: str = "health") -> list[tuple[str, str]]:
    order = [("telemetry", TELEMETRY), ("stg_telemetry", STG_TELEMETRY), ("stats", STATS), ("health", HEALTH)]
    names = [n for n, _ in order]
    return order[: names.index(upto) + 1]

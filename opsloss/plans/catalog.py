"""Registered queries: name → (spark, sf_dir) → DataFrame, and their SQL oracles.

Every query reads the provided tables (through the adapters) over their
whole extent; report dates are fixed parameters whose windows cover the
data. Column names are aliased identically on both sides.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampNTZType

from .. import schemas as S
from ..functions.dates import try_parse_date, week_start
from ..functions.rounding import round_n
from ..functions.rounding import sql_round_n as R
from ..operators import calibration as C
from ..operators import equipment as E
from ..operators import histogram as H
from ..operators import joins as J
from ..operators import losses as L
from ..operators import narrative as N
from ..operators import quality as Q
from ..operators import reports as Rp
from ..operators import versioning as V
from ..session import fresh_dir
from ..sources import adapters as A
from ..sources import dims as D
from ..sources import ingest as I
from ..sources import snapshots as SN
from ..sources import storage as ST
from ..sources import tables as T
from ..streaming import aggregates as SA
from ..streaming import ingest as SI
from . import jobs as JB
from . import oracle as O
from . import requests as RQ
from .models import Models

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries: each raw report window starts
# at the first day of its table, so it spans the whole table.
RAW_REPORT_TS = {"events": _dt.datetime(2024, 1, 2), "lineitem": _dt.datetime(1995, 1, 3)}
# Calibration "now" and lookback per adapter: the events table spans 30 days
# (the reference's default lookback); the lineitem table spans ~7 years.
CALIBRATION = {"events": (_dt.datetime(2024, 1, 31), C.LOOKBACK_DAYS),
               "lineitem": (_dt.datetime(2001, 11, 5), 2500)}
TOP_N = Rp.DEFAULT_TOP_N
SYNC_TIMES = (_dt.datetime(2024, 1, 1, 6, 0), _dt.datetime(2024, 1, 2, 6, 0))

_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        _Q[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _m(spark, sf_dir, source="events") -> Models:
    return Models(spark, sf_dir, source)


# ================================================================ staging

register("stg_events", O.with_(O.base_ctes(upto="stg_events"), "SELECT * FROM stg_events"))(
    lambda spark, d: _m(spark, d).stg_events)

register("stg_telemetry", O.with_(O.telemetry_ctes("stg_telemetry"), "SELECT * FROM stg_telemetry"))(
    lambda spark, d: _m(spark, d).stg_telemetry)

# ================================================================ losses

def _ops_enriched(spark, d):
    e = _m(spark, d).enriched
    keep = [c for c in e.columns if c not in ("delta_sec", "loss")]
    return e.select(*keep, round_n("delta_sec", 2).alias("delta_sec"), round_n("loss", 6).alias("loss"))


register("ops_enriched", O.with_(O.base_ctes(upto="enriched"), f"""
  SELECT case_id, operation_name, event_date, start_time, end_time, duration_seconds, user_id,
         norm_seconds, role_id, role_name, hourly_rate, {R('delta_sec', 2)} AS delta_sec,
         {R('loss', 6)} AS loss FROM enriched"""))(_ops_enriched)

register("mart_daily_losses", O.with_(O.base_ctes(), "SELECT * FROM mart"))(
    lambda spark, d: _m(spark, d).mart_daily_losses)

register("mart_daily_losses_lineitem", O.with_(O.base_ctes("lineitem"), "SELECT * FROM mart"))(
    lambda spark, d: _m(spark, d, "lineitem").mart_daily_losses)


RAW_SELECT = f"""
  SELECT p.operation_name, p.event_count, p.avg_duration_sec, p.total_duration_sec,
         d.norm_seconds, d.hourly_rate, d.role_name,
         greatest(p.avg_duration_sec - cast(d.norm_seconds as double), 0.0::double) AS delta_sec,
         greatest(p.avg_duration_sec - cast(d.norm_seconds as double), 0.0::double) / 3600.0::double
           * d.hourly_rate AS loss_per_event,
         {R('greatest(p.avg_duration_sec - cast(d.norm_seconds as double), 0.0::double) / 3600.0::double * d.hourly_rate * cast(p.event_count as double)', 2)} AS total_loss,
         {O.minutes('p.avg_duration_sec')} AS avg_duration_min,
         {O.minutes('d.norm_seconds')} AS norm_min
  FROM per_op p JOIN dims d ON p.operation_name = d.operation_name"""


def _raw_ctes(source: str, ts: _dt.datetime | None = None) -> list[tuple[str, str]]:
    since = (ts or RAW_REPORT_TS[source]) - _dt.timedelta(hours=24)
    return O.base_ctes(source, upto="dims") + [("per_op", f"""
  SELECT operation_name, cast(count(*) as bigint) AS event_count,
         avg(duration_seconds) AS avg_duration_sec,
         cast(sum(duration_seconds) as bigint) AS total_duration_sec
  FROM event_logs WHERE start_time >= TIMESTAMP '{since:%Y-%m-%d %H:%M:%S}'
  GROUP BY operation_name""")]


def _raw_sql(source: str) -> str:
    return O.with_(_raw_ctes(source), RAW_SELECT)


def _raw(source):
    def q(spark, d):
        m = _m(spark, d, source)
        return L.daily_losses_raw(m.event_logs, m.dims, RAW_REPORT_TS[source])
    return q


register("daily_losses_raw", _raw_sql("events"))(_raw("events"))


def _raw_by_day(spark, d):
    m = _m(spark, d)
    return L.daily_losses_raw_by_day(m.event_logs, m.dims)


register("daily_losses_raw_bounded_by_day", O.with_(O.base_ctes(upto="dims") + [("per_op", """
  SELECT cast(start_time as date) + 1 AS report_date, operation_name, cast(count(*) as bigint) AS event_count,
         avg(duration_seconds) AS avg_duration_sec,
         cast(sum(duration_seconds) as bigint) AS total_duration_sec
  FROM event_logs GROUP BY 1, 2""")], RAW_SELECT.replace("SELECT p.operation_name", "SELECT p.report_date, p.operation_name", 1)))(
    _raw_by_day)
register("daily_losses_raw_lineitem", _raw_sql("lineitem"))(_raw("lineitem"))

# Every report date, each with its own window without upper bound.
RAW_ALL_CTES = O.base_ctes(upto="dims") + [
    ("dates", """
  SELECT cast(unnest(generate_series(min(cast(start_time as date)) + 1, max(cast(start_time as date)) + 1,
                                     INTERVAL 1 DAY)) as date) AS report_date FROM event_logs"""),
    ("per_op", """
  SELECT report_date, operation_name, cast(count(*) as bigint) AS event_count,
         avg(duration_seconds) AS avg_duration_sec,
         cast(sum(duration_seconds) as bigint) AS total_duration_sec
  FROM dates JOIN event_logs ON start_time >= cast(report_date as timestamp) - INTERVAL 24 HOURS
  GROUP BY report_date, operation_name"""),
    ("losses", RAW_SELECT.replace("SELECT p.operation_name", "SELECT p.report_date, p.operation_name", 1))]


def _raw_all(spark, d, source="events"):
    m = _m(spark, d, source)
    return Rp.losses_raw(m.event_logs, m.dims)


register("daily_losses_raw_every_date", O.with_(RAW_ALL_CTES, "SELECT * FROM losses"))(_raw_all)


# ================================================================ equipment

register("telemetry_daily_stats", O.with_(O.telemetry_ctes("stats"), f"""
  SELECT reading_date, equipment_id, equipment_name, metric_name, unit, reading_count,
         {R('avg_value', 3)} AS avg_value, {R('min_value', 3)} AS min_value,
         {R('max_value', 3)} AS max_value, {R('stddev_value', 3)} AS stddev_value,
         warning_count, maintenance_count, idle_count
  FROM stats"""))(lambda spark, d: E.rounded_daily_stats(_m(spark, d).telemetry_stats))

register("mart_equipment_health", O.with_(O.telemetry_ctes("health"), "SELECT * FROM health"))(
    lambda spark, d: _m(spark, d).mart_equipment_health)


# ================================================================ daily reports

MONEY = "format('{{:,.2f}}', {})"


def money_sql(expr: str) -> str:
    return MONEY.format(R(expr, 2))


def whole_sql(expr: str) -> str:
    return f"cast(cast(round_even(cast({expr} as double), 0) as bigint) as varchar)"


def one_decimal_sql(expr: str) -> str:
    return f"printf('%.1f', {R(expr, 1)})"


LOSSES_MARTS = f"""
  SELECT event_date AS report_date, operation_name, role_name, event_count, avg_duration_sec,
         norm_seconds, hourly_rate, delta_sec, total_loss,
         {O.minutes('avg_duration_sec')} AS avg_duration_min, {O.minutes('norm_seconds')} AS norm_min
  FROM mart"""
TOTALS = f"""
  SELECT report_date, {R('coalesce(sum(total_loss), 0.0)', 2)} AS total_loss,
         cast(coalesce(sum(event_count), 0) as bigint) AS total_events
  FROM losses GROUP BY report_date"""
TOP = f"""
  SELECT report_date, cast(rank as integer) AS rank, operation_name,
         {R('avg_duration_sec', 1)} AS avg_duration_sec, cast(norm_seconds as integer) AS norm_seconds,
         {R('delta_sec', 1)} AS delta_sec, cast(hourly_rate as double) AS hourly_rate,
         cast(total_loss as double) AS total_loss, cast(event_count as bigint) AS event_count
  FROM (SELECT *, row_number() OVER (PARTITION BY report_date
                                     ORDER BY total_loss DESC, operation_name ASC) AS rank
        FROM losses) WHERE rank <= {TOP_N}"""


def marts_report_ctes() -> list[tuple[str, str]]:
    return O.base_ctes() + [("losses", LOSSES_MARTS), ("totals", TOTALS), ("top", TOP)]


def raw_report_ctes() -> list[tuple[str, str]]:
    ts = RAW_REPORT_TS["events"]
    return _raw_ctes("events") + [("losses", f"""
  SELECT DATE '{ts:%Y-%m-%d}' AS report_date, * FROM ({RAW_SELECT}
  )""")]


def _marts_losses(spark, d):
    return Rp.losses_from_mart(_m(spark, d).mart_daily_losses)


def _raw_losses(spark, d):
    m = _m(spark, d)
    return Rp.losses_raw(m.event_logs, m.dims, RAW_REPORT_TS["events"])


register("daily_report_losses_marts", O.with_(marts_report_ctes(), "SELECT * FROM losses"))(_marts_losses)

register("daily_report_totals_marts", O.with_(marts_report_ctes(), "SELECT * FROM totals"))(
    lambda spark, d: Rp.report_totals(_marts_losses(spark, d)))

register("top_anomalies_marts", O.with_(marts_report_ctes(), "SELECT * FROM top"))(
    lambda spark, d: Rp.top_anomalies(_marts_losses(spark, d), TOP_N))

register("daily_report_totals_raw", O.with_(raw_report_ctes(), f"""
  SELECT DATE '{RAW_REPORT_TS['events']:%Y-%m-%d}' AS report_date,
         {R('coalesce(sum(total_loss), 0.0)', 2)} AS total_loss,
         cast(coalesce(sum(event_count), 0) as bigint) AS total_events
  FROM losses"""))(
    lambda spark, d: Rp.report_totals(_raw_losses(spark, d), single=RAW_REPORT_TS["events"].date()))

register("top_anomalies_raw", O.with_(raw_report_ctes() + [("top", TOP)], "SELECT * FROM top"))(
    lambda spark, d: Rp.top_anomalies(_raw_losses(spark, d), TOP_N))


register("top_anomalies_raw_every_date", O.with_(RAW_ALL_CTES + [("top", TOP)], "SELECT * FROM top"))(
    lambda spark, d: Rp.build_daily_report("raw", None, TOP_N, event_logs=_m(spark, d).event_logs, dims=_m(spark, d).dims).anomalies)


def _pulse(spark, d):
    return Rp.report_pulse(_marts_losses(spark, d), TOP_N)


PULSE = f"""
  SELECT t.report_date, strftime(t.report_date, '%d.%m.%Y %H:%M') || ' UTC' AS report_title,
         t.total_loss, t.total_events,
         coalesce(c.anomaly_count, 0) AS anomaly_count,
         f.operation_name AS top_operation, f.total_loss AS top_loss,
         {money_sql('t.total_loss')} AS total_loss_text,
         CASE WHEN f.total_loss IS NULL THEN NULL ELSE {money_sql('f.total_loss')} END AS top_loss_text
  FROM totals t
  LEFT JOIN (SELECT report_date, cast(count(*) as bigint) AS anomaly_count FROM top GROUP BY report_date) c
    ON t.report_date = c.report_date
  LEFT JOIN (SELECT * FROM top WHERE rank = 1) f ON t.report_date = f.report_date"""
register("report_pulse", O.with_(marts_report_ctes(), PULSE))(_pulse)

register("report_loss_table", O.with_(marts_report_ctes(), f"""
  SELECT report_date, operation_name, avg_duration_min, norm_min, {R('delta_sec', 1)} AS delta_sec,
         hourly_rate, cast(event_count as bigint) AS event_count, total_loss
  FROM losses"""))(lambda spark, d: Rp.report_loss_table(_marts_losses(spark, d)))


def _analysis(spark, d):
    return Rp.report_analysis_lines(_marts_losses(spark, d))


TOP_ROW = ("t1", "  SELECT * FROM top WHERE rank = 1")
FALLBACK = f"'operation_name=' || operation_name || '; delta_sec=' || {whole_sql('delta_sec')} || '; cause=unknown'"
ANALYSIS = f"""
  SELECT report_date, 1 AS line_no, 'operation_name=' || operation_name AS line FROM t1
  UNION ALL SELECT report_date, 2, 'avg_duration_sec=' || {whole_sql('avg_duration_sec')} FROM t1
  UNION ALL SELECT report_date, 3, 'norm_seconds=' || cast(norm_seconds as varchar) FROM t1
  UNION ALL SELECT report_date, 4, 'delta_sec=' || {whole_sql('delta_sec')} FROM t1
  UNION ALL SELECT report_date, 5, 'total_loss=' || {money_sql('total_loss')} FROM t1
  UNION ALL SELECT report_date, 6, {FALLBACK} FROM t1
  UNION ALL
  SELECT report_date, 1, 'anomalies=0' FROM totals
  WHERE report_date NOT IN (SELECT report_date FROM t1)"""
register("report_analysis_lines", O.with_(marts_report_ctes() + [TOP_ROW], ANALYSIS))(_analysis)


# ================================================================ report texts

register("anomaly_prompt_text", O.with_(marts_report_ctes(), f"""
  SELECT report_date, rank, operation_name,
         'operation_name=' || operation_name || '; avg_duration_sec=' || {whole_sql('avg_duration_sec')}
         || '; norm_seconds=' || cast(norm_seconds as varchar) || '; delta_sec=' || {whole_sql('delta_sec')}
         || '; hourly_rate=' || {money_sql('hourly_rate')} || '; total_loss=' || {money_sql('total_loss')}
         || '; event_count=' || cast(event_count as varchar)
         || '; avg_duration_min=' || {one_decimal_sql('avg_duration_sec / 60.0::double')}
         || '; norm_min=' || {one_decimal_sql('cast(norm_seconds as double) / 60.0::double')} AS prompt_text
  FROM top"""))(lambda spark, d: N.anomaly_prompts(Rp.top_anomalies(_marts_losses(spark, d), TOP_N)))

register("anomaly_fallback_text", O.with_(marts_report_ctes(), f"""
  SELECT report_date, rank, operation_name, {FALLBACK} AS fallback_text
  FROM top"""))(lambda spark, d: N.anomaly_fallbacks(Rp.top_anomalies(_marts_losses(spark, d), TOP_N)))

register("report_caption", O.with_(marts_report_ctes(), f"""
  SELECT report_date,
         'total_loss=' || {money_sql('total_loss')} AS caption
  FROM totals"""))(lambda spark, d: N.report_captions(Rp.report_totals(_marts_losses(spark, d))))


# ================================================================ weekly reports

WEEKLY_MARTS = f"""
  SELECT week_start, operation_name, role_name, event_count,
         {R('_avg', 6)} AS avg_duration_sec, norm_seconds, hourly_rate,
         {R('_delta', 6)} AS delta_sec, {R('_loss', 2)} AS total_loss,
         {O.minutes('_avg')} AS avg_duration_min, {O.minutes('norm_seconds')} AS norm_min
  FROM (SELECT cast(date_trunc('week', event_date) as date) AS week_start, operation_name,
               arg_max(role_name, event_date) AS role_name,
               cast(sum(event_count) as bigint) AS event_count,
               avg(avg_duration_sec) AS _avg,
               arg_max(norm_seconds, event_date) AS norm_seconds,
               arg_max(hourly_rate, event_date) AS hourly_rate,
               avg(delta_sec) AS _delta, sum(total_loss) AS _loss
        FROM mart GROUP BY 1, 2)"""

register("weekly_losses_marts", O.with_(O.base_ctes() + [("weekly", WEEKLY_MARTS)], "SELECT * FROM weekly"))(
    lambda spark, d: Rp.weekly_losses_marts(_m(spark, d).mart_daily_losses))

register("weekly_losses_marts_lineitem",
         O.with_(O.base_ctes("lineitem") + [("weekly", WEEKLY_MARTS)], "SELECT * FROM weekly"))(
    lambda spark, d: Rp.weekly_losses_marts(_m(spark, d, "lineitem").mart_daily_losses))

WEEKLY_RAW = f"""
  SELECT week_start, operation_name, '' AS role_name, event_count,
         {R('_avg', 6)} AS avg_duration_sec, 0 AS norm_seconds, 0.0::double AS hourly_rate,
         0.0::double AS delta_sec, 0.0::double AS total_loss,
         {O.minutes('_avg')} AS avg_duration_min, 0.0::double AS norm_min
  FROM (SELECT cast(date_trunc('week', start_time) as date) AS week_start, operation_name,
               cast(count(*) as bigint) AS event_count, avg(duration_seconds) AS _avg
        FROM event_logs GROUP BY 1, 2)"""
register("weekly_losses_raw", O.with_(O.base_ctes(upto="event_logs"), WEEKLY_RAW))(
    lambda spark, d: Rp.weekly_losses_raw(_m(spark, d).event_logs))

register("weekly_totals", O.with_(O.base_ctes() + [("weekly", WEEKLY_MARTS)], f"""
  SELECT week_start, {R('coalesce(sum(total_loss), 0.0)', 2)} AS total_loss,
         cast(coalesce(sum(event_count), 0) as bigint) AS total_events
  FROM weekly GROUP BY week_start"""))(
    lambda spark, d: Rp.weekly_totals(Rp.weekly_losses_marts(_m(spark, d).mart_daily_losses)))

WEEKLY_CTES = O.base_ctes() + [
    ("weekly", WEEKLY_MARTS),
    ("losses", "  SELECT week_start AS report_date, * EXCLUDE (week_start) FROM weekly"),
    ("totals", TOTALS), ("top", TOP), TOP_ROW]


def _by_week(select: str) -> str:
    return O.with_(WEEKLY_CTES, f"SELECT report_date AS week_start, * EXCLUDE (report_date) FROM ({select})")


def _weekly_report(spark, d):
    return Rp.build_weekly_report("marts", top_n=TOP_N, mart=_m(spark, d).mart_daily_losses)


register("weekly_top_anomalies", _by_week("SELECT * FROM top"))(lambda spark, d: _weekly_report(spark, d).anomalies)
register("weekly_pulse", _by_week(PULSE))(lambda spark, d: _weekly_report(spark, d).pulse)
register("weekly_analysis_lines", _by_week(ANALYSIS))(lambda spark, d: _weekly_report(spark, d).analysis)


# One report time, day and week inside the data, so that the predicates drop rows.
INSIDE_TS, INSIDE_DAY, INSIDE_WEEK = _dt.datetime(2024, 1, 17, 9, 30), _dt.date(2024, 1, 10), _dt.date(2024, 1, 8)


def _raw_inside(spark, d):
    m = _m(spark, d)
    return L.daily_losses_raw(m.event_logs, m.dims, INSIDE_TS)


register("daily_losses_raw_inside", O.with_(_raw_ctes("events", INSIDE_TS), RAW_SELECT))(_raw_inside)
register("daily_report_pulse_one_date", O.with_(
    O.base_ctes() + [("losses", f"SELECT * FROM ({LOSSES_MARTS}) WHERE report_date = DATE '{INSIDE_DAY}'"),
                     ("totals", TOTALS), ("top", TOP)], PULSE))(
    lambda spark, d: Rp.build_daily_report("marts", INSIDE_DAY, TOP_N, mart=_m(spark, d).mart_daily_losses).pulse)
register("weekly_losses_marts_one_week", O.with_(
    O.base_ctes() + [("weekly", WEEKLY_MARTS)], f"SELECT * FROM weekly WHERE week_start = DATE '{INSIDE_WEEK}'"))(
    lambda spark, d: Rp.weekly_losses_marts(_m(spark, d).mart_daily_losses, INSIDE_WEEK))
register("weekly_losses_raw_one_week", O.with_(
    O.base_ctes(upto="event_logs") + [("weekly", WEEKLY_RAW)],
    f"SELECT * FROM weekly WHERE week_start = DATE '{INSIDE_WEEK}'"))(
    lambda spark, d: Rp.sort_weekly(Rp.weekly_losses_raw(_m(spark, d).event_logs, INSIDE_WEEK), "raw"))


# ================================================================ calibration

def _calibration_sql(final: str, source: str = "events") -> str:
    asof, lookback = CALIBRATION[source]
    since = asof - _dt.timedelta(days=lookback)
    stats = f"""
  SELECT operation_name, event_count, mean_sec, median_sec, std_sec, p75_sec,
         cast(round_even(median_sec + 0.5::double * std_sec, 0) as integer) AS recommended_norm_sec
  FROM (SELECT operation_name, cast(count(*) as bigint) AS event_count,
               {R('avg(duration_seconds)', 1)} AS mean_sec,
               {R('median(duration_seconds)', 1)} AS median_sec,
               {R('stddev_samp(duration_seconds)', 1)} AS std_sec,
               {R('quantile_cont(duration_seconds, 0.75)', 1)} AS p75_sec
        FROM event_logs
        WHERE start_time >= TIMESTAMP '{since:%Y-%m-%d %H:%M:%S}'
          AND duration_seconds > 0 AND duration_seconds < 86400
        GROUP BY operation_name)"""
    return O.with_(O.base_ctes(source, upto="stg_norms") + [("cal", stats)], final)


def _cal_stats(spark, d, source="events"):
    asof, lookback = CALIBRATION[source]
    return C.calibration_stats(C.calibration_window(_m(spark, d, source).event_logs, asof, lookback))


register("calibration_stats", _calibration_sql("SELECT * FROM cal"))(_cal_stats)

NORM_CALIBRATION_FINAL = f"""
  SELECT c.*, n.norm_seconds AS current_norm_sec,
         c.recommended_norm_sec - n.norm_seconds AS delta_sec,
         {R('cast(c.recommended_norm_sec - n.norm_seconds as double) / nullif(cast(n.norm_seconds as double), 0.0) * 100.0::double', 1)} AS delta_pct
  FROM cal c LEFT JOIN stg_norms n ON c.operation_name = n.operation_name"""

register("norm_calibration", _calibration_sql(NORM_CALIBRATION_FINAL))(
    lambda spark, d: C.norm_calibration(_cal_stats(spark, d), _m(spark, d).stg_norms))

register("norm_calibration_lineitem", _calibration_sql(NORM_CALIBRATION_FINAL, "lineitem"))(
    lambda spark, d: C.norm_calibration(_cal_stats(spark, d, "lineitem"), _m(spark, d, "lineitem").stg_norms))


# ================================================================ data quality

DQ_CTE = {
    "stg_event_logs": "stg_events", "stg_process_norms": "stg_norms", "stg_rates": "stg_rates",
    "stg_telemetry": "stg_telemetry", "int_operations_enriched": "enriched",
    "int_telemetry_daily_stats": "stats", "mart_daily_losses": "mart", "mart_equipment_health": "health",
}


def _dq_ctes(source: str = "events") -> list[tuple[str, str]]:
    return O.base_ctes(source) + O.telemetry_ctes()


def _not_null_sql(check_col: str = "null_count", with_check: bool = False) -> str:
    parts = []
    for model, cols in Q.NOT_NULL_TESTS.items():
        for c in cols:
            head = "'not_null' AS check_name, " if with_check else ""
            parts.append(f"  SELECT {head}'{model}' AS model, '{c}' AS column_name, "
                         f"cast(count(*) FILTER (WHERE {c} IS NULL) as bigint) AS {check_col} "
                         f"FROM {DQ_CTE[model]}")
    return "\n  UNION ALL\n".join(parts)


def _dup_sql(model: str, cols: list[str], key_col: str, check: str | None = None) -> str:
    key = f"cast({cols[0]} as varchar)" if len(cols) == 1 else \
        "concat_ws('::', " + ", ".join(f"cast({c} as varchar)" for c in cols) + ")"
    head = f"'{check}' AS check_name, " if check else ""
    tail = "" if check else ", cast(coalesce(sum(n), 0) as bigint) AS duplicate_rows"
    return (f"  SELECT {head}'{model}' AS model, '{'::'.join(cols)}' AS column_name, "
            f"cast(count(*) as bigint) AS {key_col}{tail} "
            f"FROM (SELECT {key} AS k, count(*) AS n FROM {DQ_CTE[model]} GROUP BY k HAVING count(*) > 1)")


def _dq_models(spark, d, source="events"):
    return _m(spark, d, source).quality_models()


def _dq_not_null(spark, d):
    """L1 of every model from one scan of each fact table."""
    found = _m(spark, d).dq_summary().filter("check_name = 'not_null'")
    return found.select("model", "column_name", F.col("failures").alias("null_count"))


register("dq_not_null", O.with_(_dq_ctes(), _not_null_sql()))(_dq_not_null)


def _dq_composite(spark, d):
    from functools import reduce
    ms = _dq_models(spark, d)
    return reduce(DataFrame.unionByName,
                  [Q.duplicate_summary(ms[m], m, cols) for m, cols in Q.COMPOSITE_UNIQUE_TESTS.items()])


register("dq_composite_unique", O.with_(_dq_ctes(), "\n  UNION ALL\n".join(
    _dup_sql(m, cols, "duplicate_keys") for m, cols in Q.COMPOSITE_UNIQUE_TESTS.items())))(_dq_composite)

register("dq_accepted_values", O.with_(O.telemetry_ctes("stg_telemetry"), """
  SELECT equipment_state AS value, cast(count(*) as bigint) AS n FROM stg_telemetry
  WHERE equipment_state NOT IN ('running', 'idle', 'warning', 'maintenance', 'error', 'off')
  GROUP BY equipment_state"""))(
    lambda spark, d: Q.unaccepted_values(_m(spark, d).stg_telemetry, "equipment_state"))

register("dq_no_negative_losses", O.with_(O.base_ctes(), """
  SELECT event_date, operation_name, total_loss FROM mart WHERE total_loss < 0"""))(
    lambda spark, d: Q.negative_losses(_m(spark, d).mart_daily_losses))

register("dq_duration_range", O.with_(O.base_ctes(upto="stg_events"), """
  SELECT case_id, duration_seconds FROM stg_events
  WHERE duration_seconds <= 0 OR duration_seconds >= 86400"""))(
    lambda spark, d: Q.durations_out_of_range(_m(spark, d).stg_events))


def _dq_summary_sql() -> str:
    parts = [_not_null_sql("failures", with_check=True)]
    for m, cols in Q.UNIQUE_TESTS.items():
        parts += [_dup_sql(m, [c], "failures", "unique") for c in cols]
    parts += [_dup_sql(m, cols, "failures", "unique_combination")
              for m, cols in Q.COMPOSITE_UNIQUE_TESTS.items()]
    parts.append("""  SELECT 'accepted_values', 'stg_telemetry', 'equipment_state', cast(count(*) as bigint)
  FROM stg_telemetry
  WHERE equipment_state NOT IN ('running', 'idle', 'warning', 'maintenance', 'error', 'off')""")
    parts.append("""  SELECT 'no_negative_losses', 'mart_daily_losses', 'total_loss', cast(count(*) as bigint)
  FROM mart WHERE total_loss < 0""")
    parts.append("""  SELECT 'duration_in_range', 'stg_event_logs', 'duration_seconds', cast(count(*) as bigint)
  FROM stg_events WHERE duration_seconds <= 0 OR duration_seconds >= 86400""")
    return "\n  UNION ALL\n".join(parts)


register("dq_summary", O.with_(_dq_ctes(), _dq_summary_sql()))(
    lambda spark, d: _m(spark, d).dq_summary())

register("dq_summary_lineitem", O.with_(_dq_ctes("lineitem"), _dq_summary_sql()))(
    lambda spark, d: _m(spark, d, "lineitem").dq_summary())


def _dq_violations(spark, d):
    """L1-L6 over frames that break the rules: unstaged facts, orders as if one per customer, balances as losses."""
    from functools import reduce
    m, orders, cols = _m(spark, d), T.table(spark, d, "orders"), ("check_name", "model", "column_name", "failures")
    seconds = F.col("duration_seconds")
    parts = [
        Q.null_counts(m.telemetry, "telemetry", ["metric_value", "equipment_id"])
         .select(F.lit("not_null").alias("check_name"), "model", "column_name", F.col("null_count").alias("failures")),
        Q._row_counts(m.event_logs, [("duration_in_range", "event_logs", "duration_seconds",
                                      (seconds <= Q.MIN_DURATION_EXCLUSIVE) | (seconds >= Q.MAX_DURATION_EXCLUSIVE))]),
        Q._summary_row("accepted_values", "telemetry", "equipment_state",
                       Q.unaccepted_values(m.telemetry, "equipment_state", ["running", "idle"]), "n"),
        Q._summary_row("no_negative_losses", "customer", "c_acctbal", Q.negative_losses(
            T.table(spark, d, "customer").select(F.lit(None).cast("date").alias("event_date"),
                                                 F.col("c_name").alias("operation_name"),
                                                 F.col("c_acctbal").alias("total_loss")))),
    ]
    for check, keys in (("unique", ["o_custkey"]), ("unique_combination", ["o_custkey", "o_orderpriority"])):
        parts.append(Q.duplicate_summary(orders, "orders", keys).select(
            F.lit(check).alias("check_name"), "model", "column_name", F.col("duplicate_keys").alias("failures")))
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts]) \
        .withColumn("blocks_reports", F.col("failures") > 0)


register("dq_violations", O.with_(O.base_ctes(upto="event_logs") + O.telemetry_ctes("telemetry"), """
  SELECT *, failures > 0 AS blocks_reports FROM (
  SELECT 'not_null' AS check_name, 'telemetry' AS model, 'metric_value' AS column_name,
         cast(count(*) as bigint) AS failures FROM telemetry WHERE metric_value IS NULL
  UNION ALL SELECT 'not_null', 'telemetry', 'equipment_id', count(*) FROM telemetry WHERE equipment_id IS NULL
  UNION ALL SELECT 'duration_in_range', 'event_logs', 'duration_seconds', count(*) FROM event_logs
    WHERE NOT (duration_seconds > 0 AND duration_seconds < 86400)
  UNION ALL SELECT 'accepted_values', 'telemetry', 'equipment_state', count(*) FROM telemetry
    WHERE equipment_state NOT IN ('running', 'idle')
  UNION ALL SELECT 'no_negative_losses', 'customer', 'c_acctbal', count(*) FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'unique', 'orders', 'o_custkey', count(*) FROM (
    SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'unique_combination', 'orders', 'o_custkey::o_orderpriority', count(*) FROM (
    SELECT o_custkey, o_orderpriority FROM orders GROUP BY 1, 2 HAVING count(*) > 1))"""))(_dq_violations)


# ================================================================ ingest (batch and streaming)



def _requests(spark, d, kind: str) -> str:
    path = fresh_dir(spark, f"requests_{kind}")
    write = RQ.write_event_requests if kind == "events" else RQ.write_reading_requests
    write(T.table(spark, d, "events"), path)
    return path


def _judged(spark, d, kind):
    return I.validated(I.read_lines(spark, _requests(spark, d, kind)), kind)


TELEMETRY_BATCHED = O.TELEMETRY.replace("SELECT ts,", f"SELECT event_id // {RQ.ROWS} AS batch_id, ts,", 1)
EVENTS_BATCHED = ("SELECT event_id // {} AS batch_id, event_logs.* FROM event_logs JOIN "
                  "(SELECT event_id, 'CASE-' || lpad(cast(event_id as varchar), cast(greatest({}, length(cast(event_id as varchar))) as integer), '0') AS case_id "
                  "FROM events) USING (case_id)").format(RQ.ROWS, A.CASE_WIDTH)


def _judged_sql(table: str, missing: str, null: str) -> str:
    """What becomes of each request: NULL, or why it is rejected, and how many rows it says to have."""
    rule = lambda r: f"batch_id % {r[0]} = {r[1]}"
    return f"""
  SELECT batch_id, CASE WHEN {rule(RQ.CUT)} THEN 'corrupt' WHEN {rule(RQ.EMPTY)} THEN 'empty'
           WHEN count(*) FILTER (WHERE {missing}) > 0 THEN 'missing_required'
           WHEN {rule(RQ.NULLS)} AND count(*) FILTER (WHERE {null}) > 0 THEN 'null_value' END AS reject_reason,
         CASE WHEN {rule(RQ.CUT)} OR {rule(RQ.EMPTY)} THEN 0 ELSE count(*) END AS row_count
  FROM {table} GROUP BY batch_id"""


HAS_DEFAULT = " OR ".join(f"{f} = {v!r}" for f, v in S.READING_DEFAULTS.items())
READING_CTES = [("tb", TELEMETRY_BATCHED), ("judged", _judged_sql("tb", "metric_value IS NULL", HAS_DEFAULT))]
EVENT_CTES = O.base_ctes(upto="event_logs") + [("eb", EVENTS_BATCHED), ("judged", _judged_sql("eb", "false", "false"))]
TEL_COLS = ", ".join(f"date_trunc('millisecond', ts) AS ts" if f.name == "ts" else f.name
                     for f in S.TELEMETRY.fields)
EVT_COLS = ", ".join(f"date_trunc('second', {f.name}) AS {f.name}" if f.name in ("start_time", "end_time")
                     else f.name for f in S.EVENT_LOGS.fields)
IN_EVENTS = f"SELECT {EVT_COLS}%s FROM eb WHERE batch_id IN (SELECT batch_id FROM judged WHERE reject_reason IS NULL)"
IN_READINGS = f"SELECT {TEL_COLS}%s FROM tb WHERE batch_id IN (SELECT batch_id FROM judged WHERE reject_reason IS NULL)"
REJECTS = """
  SELECT CASE WHEN reject_reason <> 'corrupt' THEN batch_id END AS batch_id,
         cast(CASE WHEN reject_reason <> 'corrupt' THEN 0 END as bigint) AS batch_part, reject_reason,
         cast(row_count as bigint) AS row_count
  FROM judged WHERE reject_reason IS NOT NULL"""

register("ingest_events_json", O.with_(EVENT_CTES, IN_EVENTS % ""))(
    lambda spark, d: I.accepted(_judged(spark, d, "events"), "events"))
register("ingest_telemetry_defaults", O.with_(READING_CTES, IN_READINGS % ""))(
    lambda spark, d: I.accepted(_judged(spark, d, "readings"), "readings"))
register("ingest_rejects", O.with_(READING_CTES, REJECTS))(
    lambda spark, d: I.rejected(_judged(spark, d, "readings"), "readings"))


def _ingest_again(spark, d):
    """A1-A4 with a broken first run (data written, never published), a run, a repeated run and a late file."""
    wh, landing = JB.new_warehouse(spark), fresh_dir(spark, "landing")
    events = T.table(spark, d, "events")
    half = F.expr(f"event_id div {RQ.ROWS}") % 2 == 0
    RQ.write_reading_requests(events.filter(half), landing)
    publish = SN.publish
    try:
        SN.publish = _broken
        JB.ingest_job(spark, landing, wh, "readings")
    except RuntimeError:
        pass
    finally:
        SN.publish = publish
    runs = [JB.ingest_job(spark, landing, wh, "readings"), JB.ingest_job(spark, landing, wh, "readings")]
    RQ.write_reading_requests(events.filter(~half), landing)
    runs.append(JB.ingest_job(spark, landing, wh, "readings"))
    stored = JB.read_telemetry(spark, wh.path("raw", I.TABLES["readings"])).agg(F.count("*").alias("stored_rows"))
    rejects = JB.ingest_rejects(spark, wh, "readings").agg(F.count("*").alias("stored_rejects"))
    said = [(i + 1, r["inserted"], r["rejected_batches"]) for i, r in enumerate(runs)]
    runs = spark.createDataFrame(said, "run int, inserted long, rejected_batches long")
    return runs.crossJoin(F.broadcast(stored)).crossJoin(F.broadcast(rejects))


def _broken(*args, **kwargs):
    raise RuntimeError("the first run fails before it publishes")


register("ingest_job_repeated", O.with_(READING_CTES, """
  SELECT run, cast(coalesce(sum(row_count) FILTER (WHERE reject_reason IS NULL AND batch_id % 2 = part), 0) as bigint) AS inserted,
         cast(count(*) FILTER (WHERE reject_reason IS NOT NULL AND batch_id % 2 = part) as bigint) AS rejected_batches,
         cast(sum(row_count) FILTER (WHERE reject_reason IS NULL) as bigint) AS stored_rows,
         cast(count(*) FILTER (WHERE reject_reason IS NOT NULL) as bigint) AS stored_rejects
  FROM judged, (VALUES (1, 0), (2, -1), (3, 1)) AS r(run, part) GROUP BY run"""))(_ingest_again)


def _streamed(spark, d, kind):
    return SI.stream_ingest(spark, _requests(spark, d, kind), fresh_dir(spark, f"stream_ingest_{kind}"), kind)[0]


register("stream_event_ingest", O.with_(EVENT_CTES, IN_EVENTS % ", strftime(start_time, '%Y%m') AS month"))(
    lambda spark, d: SI.ingested_rows(spark, _streamed(spark, d, "events"), "events"))
register("stream_telemetry_ingest", O.with_(READING_CTES, IN_READINGS % ", strftime(ts, '%Y%m') AS month"))(
    lambda spark, d: SI.ingested_rows(spark, _streamed(spark, d, "readings"), "readings"))
register("stream_ingest_rejects", O.with_(READING_CTES, REJECTS))(
    lambda spark, d: SI.ingested_rejects(spark, _streamed(spark, d, "readings"), "readings"))


def _stream_counts(spark, d):
    """A3: what two runs of one stream say they took in; the second finds the other half of the requests."""
    landing, out = fresh_dir(spark, "landing"), fresh_dir(spark, "stream_counts")
    events = T.table(spark, d, "events")
    half, said = F.expr(f"event_id div {RQ.ROWS}") % 2 == 0, []
    for run, part in ((1, half), (2, ~half)):
        RQ.write_reading_requests(events.filter(part), landing)
        _, n = SI.stream_ingest(spark, landing, out, "readings")
        said.append((run, n["inserted"], n["rejected_batches"]))
    return spark.createDataFrame(said, "run int, inserted long, rejected_batches long")


register("stream_ingest_counts", O.with_(READING_CTES, """
  SELECT run, cast(coalesce(sum(row_count) FILTER (WHERE reject_reason IS NULL AND batch_id % 2 = part), 0) as bigint) AS inserted,
         cast(count(*) FILTER (WHERE reject_reason IS NOT NULL AND batch_id % 2 = part) as bigint) AS rejected_batches
  FROM judged, (VALUES (1, 0), (2, 1)) AS r(run, part) GROUP BY run"""))(_stream_counts)

register("stream_equipment_health", O.with_(O.telemetry_ctes("health"), "SELECT * FROM health"))(
    lambda spark, d: SA.stream_equipment_health(spark, d))

register("stream_daily_losses", O.with_(O.base_ctes(), "SELECT * FROM mart"))(
    lambda spark, d: SA.stream_daily_losses(spark, d, _m(spark, d).dims))


def _day_parts(spark, d, kind):
    """The events in four parts by day, newest first; yields after each part is in the landing folder."""
    ev, src = T.table(spark, d, "events"), fresh_dir(spark, f"{kind}_in")
    cuts = [None, _dt.datetime(2024, 1, 8), _dt.datetime(2024, 1, 15), _dt.datetime(2024, 1, 23), None]
    for lo, hi in reversed(list(zip(cuts, cuts[1:]))):
        part = ev if lo is None else ev.filter(F.col("ts") >= F.lit(lo).cast("timestamp_ntz"))
        part = part if hi is None else part.filter(F.col("ts") < F.lit(hi).cast("timestamp_ntz"))
        part.write.mode("append").parquet(src)
        yield SA.file_stream(spark, src, ev.schema)


def _stream_late(spark, d):
    """J3 over four runs, the newest days first, so that every later run brings late readings only."""
    out = fresh_dir(spark, "stream_late_out")
    for stream in _day_parts(spark, d, "stream_late"):
        SA.run_health(A.events_to_telemetry(stream), out, fold_at=2)
    return SA.health_mart(spark, out)


register("stream_health_late_days", O.with_(O.telemetry_ctes("health"), "SELECT * FROM health"))(_stream_late)


def _stream_restated(spark, d):
    """J4 over four runs of late days; between them all norms and a rate change and one operation has no norm, and the
    last refresh has the true dimensions again."""
    out, dims = fresh_dir(spark, "stream_restated"), _m(spark, d).dims
    worse = (dims.withColumn("norm_seconds", F.floor(F.col("norm_seconds") / 2).cast("int"))
             .withColumn("hourly_rate", F.col("hourly_rate") + 1).filter(F.col("operation_name") != "view"))
    for i, stream in enumerate(_day_parts(spark, d, "stream_restated")):
        SA.run_losses(A.events_to_event_logs(stream), out, fold_at=2)
        SA.refresh_losses(spark, out, worse if i == 1 else dims)
    SA.refresh_losses(spark, out, worse)
    SA.refresh_losses(spark, out, dims)
    return SA.losses_mart(spark, out)


register("stream_losses_changed_norms", O.with_(O.base_ctes(), "SELECT * FROM mart"))(_stream_restated)


def _stream_calibration(spark, d):
    """E6 from the streamed histogram alone: no fact is read again."""
    out = fresh_dir(spark, "stream_calibration")
    for stream in _day_parts(spark, d, "stream_calibration"):
        SA.run_losses(A.events_to_event_logs(stream), out, fold_at=1)
    return C.norm_calibration(H.calibration_stats(SA.histogram(spark, out), *CALIBRATION["events"]), _m(spark, d).stg_norms)


def _streamed_marts(spark, d):
    """J1-J4 as the job runs them: two rounds of new requests of both kinds, from JSON lines to both marts."""
    wh, landing = JB.new_warehouse(spark), {k: fresh_dir(spark, f"landing_{k}") for k in ("events", "readings")}
    events, half = T.table(spark, d, "events"), F.expr(f"event_id div {RQ.ROWS}") % 2 == 0
    for at, part in zip(SYNC_TIMES, (half, ~half)):
        RQ.write_event_requests(events.filter(part), landing["events"])
        RQ.write_reading_requests(events.filter(part), landing["readings"])
        JB.stream_run(spark, landing, wh, at, D.sample_rows(spark))
    return wh


ACCEPTED = "(SELECT batch_id FROM judged WHERE reject_reason IS NULL)"
STREAMED_EVENTS = ([c for c in EVENT_CTES if c[0] != "stg_events"]
                   + [("taken", f"SELECT * EXCLUDE (batch_id) FROM eb WHERE batch_id IN {ACCEPTED}"),
                      ("stg_norms", O.STG_NORMS), ("stg_rates", O.STG_RATES), ("dims", O.DIMS),
                      ("stg_events", O.STG_EVENTS.replace("FROM event_logs", "FROM taken")), ("enriched", O.ENRICHED), ("mart", O.MART)])
STREAMED_READINGS = READING_CTES + [
    ("telemetry", f"SELECT * EXCLUDE (batch_id) FROM tb WHERE batch_id IN {ACCEPTED}"), *O.telemetry_ctes()[1:]]
register("stream_run_losses", O.with_(STREAMED_EVENTS, "SELECT * FROM mart"))(
    lambda spark, d: JB.streamed_losses(spark, _streamed_marts(spark, d)))
register("stream_run_health", O.with_(STREAMED_READINGS, "SELECT * FROM health"))(
    lambda spark, d: JB.streamed_health(spark, _streamed_marts(spark, d)))

register("norm_calibration_from_histogram", _calibration_sql(NORM_CALIBRATION_FINAL))(_stream_calibration)

register("mart_daily_losses_from_histogram_lineitem", O.with_(O.base_ctes("lineitem"), "SELECT * FROM mart"))(
    lambda spark, d: H.mart_daily_losses(H.daily_histogram(_m(spark, d, "lineitem").stg_events), _m(spark, d, "lineitem").dims))


# ================================================================ dimension load and versioning


# Fixed parameters: nations of this region are "missing" in the rate table,
# so their suppliers' norms are rejected by the foreign-key check.
DROPPED_REGION = 4

NATION_RATES = "  SELECT cast(n_nationkey as integer) AS id, n_name AS role_name, " \
               "400.0::double + 20.0::double * n_regionkey AS hourly_rate FROM nation"
SUPPLIER_NORMS = "  SELECT cast(s_suppkey as integer) AS id, s_name AS operation_name, " \
                 "cast(trunc(abs(s_acctbal)) as integer) AS norm_seconds, " \
                 "cast(s_nationkey as integer) AS role_id FROM supplier"


def _bed(spark, d):
    rates = A.nation_to_rates(T.table(spark, d, "nation"))
    norms = A.supplier_to_norms(T.table(spark, d, "supplier"))
    return rates, norms


register("latest_order_per_customer", """
  SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1""")(
    lambda spark, d: V.latest_by_key(
        T.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice",
                                           "o_orderdate"),
        "o_custkey", version="o_orderdate", tiebreak=["o_orderkey"], keep_version=True))


def _sync_log(spark, log, src, at):
    """One sync of a source dimension into its log: the rows that are new or differ."""
    schema = StructType(list(src.schema.fields) + [StructField("updated_at", TimestampNTZType())])
    new = V.stamp_snapshot(V.changed_rows(src, SN.read(spark, log, schema), src.columns[0]), at)
    parts = SN.stage(new, log)
    SN.update(spark, log, lambda base: ((*base.parts, *parts), None))
    return SN.read(spark, log, schema)


def _resync(spark, d):
    """C3 + A10 + S17: two syncs of a source dimension; the second misses the rows deleted at source and changes nothing.
    The latest view keeps every row, and the log has not grown."""
    src = T.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    log = fresh_dir(spark, "dim_customer_log")
    _sync_log(spark, log, src, SYNC_TIMES[0])
    rows = _sync_log(spark, log, src.filter(F.col("c_acctbal") >= 0), SYNC_TIMES[1])
    n = rows.agg(F.count("*").alias("log_rows"))
    return V.latest_by_key(rows, "c_custkey").crossJoin(F.broadcast(n))


register("dims_resync_idempotent",
         "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, count(*) OVER () AS log_rows FROM customer")(_resync)


def _resync_changed(spark, d):
    """Three syncs; the second one carries other values for some rows, the third some of those again. The log holds
    the changed rows only, the latest view the last values."""
    src = T.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    log = fresh_dir(spark, "dim_customer_changed")
    _sync_log(spark, log, src, SYNC_TIMES[0])
    less = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") - 10000.0).otherwise(F.col("c_acctbal"))
    _sync_log(spark, log, src.withColumn("c_acctbal", less), SYNC_TIMES[1])
    back = F.when(F.col("c_acctbal") >= 5000, F.col("c_acctbal")).otherwise(less)
    rows = _sync_log(spark, log, src.withColumn("c_acctbal", back), SYNC_TIMES[1] + _dt.timedelta(days=1))
    n = rows.agg(F.count("*").alias("log_rows"))
    return V.latest_by_key(rows, "c_custkey").crossJoin(F.broadcast(n))


register("dims_resync_changed", """
  SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN c_acctbal - 10000.0::double ELSE c_acctbal END AS c_acctbal,
         (SELECT count(*) + count(*) FILTER (WHERE c_acctbal >= 0) + count(*) FILTER (WHERE c_acctbal >= 5000) FROM customer) AS log_rows
  FROM customer""")(_resync_changed)


def _create_rates(spark, d):
    """A5 + A6: the nations' rates are stored, the customers' segments requested as roles, all listed."""
    rates, norms = _bed(spark, d)
    wh = JB.new_warehouse(spark)
    JB.sync_dims(norms, rates, wh, SYNC_TIMES[0])
    JB.create_rates(spark, A.customer_to_rate_requests(T.table(spark, d, "customer")), wh, SYNC_TIMES[1])
    return JB.list_rates(spark, wh)


register("rates_created_and_listed", O.with_([("rates", NATION_RATES)], """
  SELECT * FROM rates UNION ALL
  SELECT cast((SELECT max(id) FROM rates) + row_number() OVER (ORDER BY c_custkey) as integer),
         c_mktsegment, c_acctbal FROM (
    SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn
    FROM customer WHERE c_mktsegment NOT IN (SELECT role_name FROM rates)) WHERE rn = 1"""))(_create_rates)


def _create_norms(spark, d):
    """A7 + A8: the suppliers' norms are stored, the parts requested as norms (many without a role, some
    under a name that exists), all listed."""
    rates, norms = _bed(spark, d)
    wh = JB.new_warehouse(spark)
    JB.sync_dims(norms, rates, wh, SYNC_TIMES[0])
    asked = T.table(spark, d, "part").select(
        F.col("p_partkey").alias("request_seq"), F.col("p_name").alias("operation_name"),
        F.col("p_size").cast("int").alias("norm_seconds"), (F.col("p_partkey") % 40).cast("int").alias("role_id"))
    JB.create_norms(spark, asked, wh, SYNC_TIMES[1])
    return JB.list_norms(spark, wh)


register("norms_created_and_listed", O.with_([("norms", SUPPLIER_NORMS)], """
  SELECT * FROM norms UNION ALL
  SELECT cast((SELECT max(id) FROM norms) + row_number() OVER (ORDER BY p_partkey) as integer), p_name,
         cast(p_size as integer), cast(p_partkey % 40 as integer) FROM (
    SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part
    WHERE p_partkey % 40 IN (SELECT n_nationkey FROM nation) AND p_name NOT IN (SELECT operation_name FROM norms)) WHERE rn = 1"""))(
    _create_norms)


def _dims_from_files(spark, d):
    """Six empty tables, dimensions read from a user's CSV files and synced, then a sync from empty
    files, which changes nothing; what the loss models read."""
    wh, place = JB.new_warehouse(spark), fresh_dir(spark, "dim_files")
    JB.create_tables(spark, wh)
    rates, norms = _bed(spark, d)
    for name, frame in (("norms", norms), ("rates", rates), ("none_norms", norms.limit(0)), ("none_rates", rates.limit(0))):
        frame.write.option("header", True).csv(f"{place}/{name}")
    JB.sync_dims(*D.read_source(spark, f"{place}/norms", f"{place}/rates", "csv"), wh, SYNC_TIMES[0])
    JB.sync_dims(*D.read_source(spark, f"{place}/none_norms", f"{place}/none_rates", "csv"), wh, SYNC_TIMES[1])
    JB.create_tables(spark, wh)
    return JB.warehouse_models(spark, d, wh).dims


register("dims_from_files", O.with_([("rates", NATION_RATES), ("norms", SUPPLIER_NORMS)], """
  SELECT n.operation_name, n.norm_seconds, n.role_id, r.role_name, r.hourly_rate
  FROM norms n JOIN rates r ON n.role_id = r.id"""))(_dims_from_files)


def _calibration_csv(spark, d):
    """The calibration as it stands in the CSV file, written twice over the same run date."""
    out = fresh_dir(spark, "calibration_csv")
    asof, lookback = CALIBRATION["events"]
    for _ in range(2):
        path = JB.norm_calibration_run(spark, d, asof, out, lookback)
    kinds = "operation_name string, event_count long, mean_sec double, median_sec double, std_sec double, p75_sec double, " \
            "recommended_norm_sec int, current_norm_sec int, delta_sec int, delta_pct double"
    return spark.read.schema(kinds).option("header", True).option("enforceSchema", False).csv(path)


register("calibration_csv", _SQL["norm_calibration"])(_calibration_csv)


def _strict_dates(spark, d):
    """F15, F16 over texts: ISO dates pass, other forms of the same date do not; the week before each."""
    o = T.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"))
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.col("iso")).when(k == 1, F.replace("iso", F.lit("-"), F.lit("/")))
            .when(k == 2, F.concat("iso", F.lit("x"))).otherwise(F.concat(F.lit(" "), "iso")))
    day = try_parse_date("text")
    return o.withColumn("text", text).select("o_orderkey", "text", day.alias("day"), F.date_sub(week_start(day), 7).alias("week_before"))


register("strict_dates", """
  SELECT o_orderkey, text, day, cast(date_trunc('week', day) as date) - 7 AS week_before FROM (
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN iso WHEN 1 THEN replace(iso, '-', '/') WHEN 2 THEN iso || 'x' ELSE ' ' || iso END AS text,
           CASE WHEN o_orderkey % 4 = 0 THEN cast(iso as date) END AS day
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders))""")(_strict_dates)


def _fk(spark, d):
    rates, norms = _bed(spark, d)
    nation = T.table(spark, d, "nation").filter(F.col("n_regionkey") != DROPPED_REGION)
    _, rejected = J.accept_with_parent(norms, rates.join(nation.select(F.col("n_nationkey").cast("int").alias("id")),
                                                          "id", "left_semi"), "role_id", "id")
    return rejected


register("dim_fk_rejects", O.with_([("norms", SUPPLIER_NORMS)], f"""
  SELECT * FROM norms WHERE role_id NOT IN (
    SELECT cast(n_nationkey as integer) FROM nation WHERE n_regionkey <> {DROPPED_REGION})"""))(_fk)


def _roles_with_norms(spark, d):
    rates, norms = _bed(spark, d)
    return J.children_per_parent(rates, norms, "id", "role_id", "norm_seconds")


register("roles_with_norms", O.with_([("rates", NATION_RATES), ("norms", SUPPLIER_NORMS)], """
  SELECT r.id, r.role_name, r.hourly_rate, coalesce(a.child_count, 0) AS child_count,
         a.min_value, a.max_value
  FROM rates r LEFT JOIN (SELECT role_id, cast(count(*) as bigint) AS child_count,
                                 min(norm_seconds) AS min_value, max(norm_seconds) AS max_value
                          FROM norms GROUP BY role_id) a ON r.id = a.role_id"""))(_roles_with_norms)


def _bed_norms_with_rates(spark, d):
    rates, norms = _bed(spark, d)
    return J.norms_with_rates(norms, rates.withColumnRenamed("id", "tariff_id"))


register("dim_norms_with_rates", O.with_([("rates", NATION_RATES), ("norms", SUPPLIER_NORMS)], """
  SELECT n.operation_name, n.norm_seconds, n.role_id, r.role_name, r.hourly_rate
  FROM norms n JOIN rates r ON n.role_id = r.id"""))(_bed_norms_with_rates)


def _append_new_roles(spark, d):
    rates, _ = _bed(spark, d)
    requests = A.customer_to_rate_requests(T.table(spark, d, "customer"))
    new = J.new_rows_only(requests, rates, "role_name", order_col="request_seq")
    return J.assign_ids(new, rates, "id", order_col="request_seq")


register("dim_append_new_roles", """
  SELECT cast((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY request_seq) as bigint) AS id,
         request_seq, role_name, hourly_rate FROM (
    SELECT c_custkey AS request_seq, c_mktsegment AS role_name, c_acctbal AS hourly_rate,
           row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn
    FROM customer WHERE c_mktsegment NOT IN (SELECT n_name FROM nation)) WHERE rn = 1""")(_append_new_roles)


def _dq_unique(spark, d):
    from functools import reduce
    rates, norms = _bed(spark, d)
    m = _m(spark, d)
    parts = [Q.duplicate_summary(m.stg_norms, "stg_process_norms", [c]) for c in ("norm_id", "operation_name")]
    parts += [Q.duplicate_summary(m.stg_rates, "stg_rates", [c]) for c in ("tariff_id", "role_name")]
    parts += [Q.duplicate_summary(norms, "supplier_norms", [c]) for c in ("id", "operation_name")]
    parts += [Q.duplicate_summary(rates, "nation_rates", [c]) for c in ("id", "role_name")]
    return reduce(DataFrame.unionByName, parts)


def _dq_unique_sql() -> str:
    parts = []
    for model, cte, cols in [("stg_process_norms", "stg_norms", ["norm_id", "operation_name"]),
                             ("stg_rates", "stg_rates", ["tariff_id", "role_name"]),
                             ("supplier_norms", "norms", ["id", "operation_name"]),
                             ("nation_rates", "rates", ["id", "role_name"])]:
        for c in cols:
            parts.append(
                f"  SELECT '{model}' AS model, '{c}' AS column_name, cast(count(*) as bigint) AS duplicate_keys, "
                f"cast(coalesce(sum(n), 0) as bigint) AS duplicate_rows "
                f"FROM (SELECT {c}, count(*) AS n FROM {cte} GROUP BY {c} HAVING count(*) > 1)")
    return O.with_([("stg_norms", O.STG_NORMS), ("stg_rates", O.STG_RATES),
                    ("rates", NATION_RATES), ("norms", SUPPLIER_NORMS)], "\n  UNION ALL\n".join(parts))


register("dq_unique", _dq_unique_sql())(_dq_unique)


# ================================================================ jobs and table maintenance


def _synced_before(spark):
    """A warehouse whose dimensions were synced at the first of ``SYNC_TIMES`` with other norms and
    rates, which the job's own sync must replace."""
    wh = JB.new_warehouse(spark)
    norms, rates = D.sample_rows(spark)
    JB.sync_dims(norms.withColumn("norm_seconds", F.col("norm_seconds") * 2),
                 rates.withColumn("hourly_rate", F.col("hourly_rate") + 100), wh, SYNC_TIMES[0])
    return wh


def _daily_etl(spark, d):
    paths = JB.daily_run(spark, d, SYNC_TIMES[1], D.sample_rows(spark), _synced_before(spark))
    return spark.read.parquet(paths["pulse"])


def _daily_etl_raw(spark, d):
    paths = JB.daily_run(spark, d, SYNC_TIMES[1], D.sample_rows(spark), _synced_before(spark),
                         report_date=INSIDE_DAY, mode="raw")
    return spark.read.parquet(paths["pulse"])


def _weekly_etl(spark, d):
    paths = JB.weekly_run(spark, d, SYNC_TIMES[1], D.sample_rows(spark), _synced_before(spark))
    return spark.read.parquet(paths["losses"])


register("daily_etl_run", _SQL["report_pulse"])(_daily_etl)


def _gate_verdict(spark, d):
    """L7 as the daily job gives it: facts with missing case ids and unknown states; no report may be written."""
    wh, m = JB.new_warehouse(spark), _m(spark, d)
    events = m.event_logs.withColumn("case_id", F.when(F.col("duration_seconds") % 7 != 0, F.col("case_id")))
    tel = m.telemetry.withColumn("equipment_state", F.when(F.col("equipment_id") == "EQ-003", "melting").otherwise(F.col("equipment_state")))
    try:
        JB.daily_run(spark, d, SYNC_TIMES[1], D.sample_rows(spark), wh, facts=(events, tel))
        raise AssertionError("the gate must trip")
    except Q.QualityGateError:
        reports = ST.list_dirs(spark, wh.path("reports"))
    found = spark.read.parquet(wh.path("checks", "verdict"))
    return found.select("passed", "failed_checks", "failures", F.array_join("failing", " ").alias("failing"),
                        F.lit(len(reports)).alias("reports_written"))


register("daily_gate_verdict", O.with_(O.base_ctes(upto="enriched") + O.telemetry_ctes("stg_telemetry") + [("f", """
  SELECT 'accepted_values:stg_telemetry.equipment_state' AS name, count(*) AS n FROM stg_telemetry WHERE equipment_id = 'EQ-003'
  UNION ALL SELECT 'not_null:int_operations_enriched.case_id', count(*) FROM enriched WHERE duration_seconds % 7 = 0
  UNION ALL SELECT 'not_null:stg_event_logs.case_id', count(*) FROM stg_events WHERE duration_seconds % 7 = 0""")], """
  SELECT false AS passed, count(*) AS failed_checks, cast(sum(n) as bigint) AS failures,
         string_agg(name || '=' || cast(n as varchar), ' ' ORDER BY name) AS failing, 0 AS reports_written FROM f"""))(_gate_verdict)
register("daily_etl_run_raw_every_date", O.with_(RAW_ALL_CTES + [("totals", TOTALS), ("top", TOP)], PULSE))(
    lambda spark, d: spark.read.parquet(JB.daily_run(spark, d, SYNC_TIMES[1], D.sample_rows(spark), _synced_before(spark), mode="raw")["pulse"]))
register("daily_etl_run_raw", O.with_(
    _raw_ctes("events", _dt.datetime.combine(INSIDE_DAY, _dt.time())) +
    [("losses", f"  SELECT DATE '{INSIDE_DAY}' AS report_date, * FROM ({RAW_SELECT})"), ("totals", TOTALS), ("top", TOP)],
    PULSE))(_daily_etl_raw)
register("weekly_etl_run", _SQL["weekly_losses_marts"])(_weekly_etl)

# Fixed parameters: the month rebuilt by the partition-rewrite query and the
# "now" of the retention query.
REWRITE_MONTH = _dt.date(1998, 6, 1)
RETENTION_ASOF = _dt.datetime(2025, 1, 15, 12, 0)


def _partition_rewrite(spark, d):
    """The full mart is written, then one month is rebuilt from its facts without those of one ship mode; all
    other months must keep their rows, and a reader of the old version still sees all of it."""
    m = _m(spark, d, "lineitem")
    wh = JB.new_warehouse(spark)
    JB.build_marts(m, wh)
    before = JB.read_mart(spark, wh.mart_losses, S.MART_DAILY_LOSSES)
    fewer = A.lineitem_to_event_logs(T.table(spark, d, "lineitem").filter("l_linenumber > 2"))
    JB.build_marts(Models(spark, d, "lineitem", event_logs=fewer), wh, REWRITE_MONTH, REWRITE_MONTH)
    return JB.read_mart(spark, wh.mart_losses, S.MART_DAILY_LOSSES).withColumn("version", F.lit("new")).unionByName(
        before.withColumn("version", F.lit("old")))


IN_MONTH = f"strftime(event_date, '%Y%m') = '{REWRITE_MONTH:%Y%m}'"
FEWER = [(f"fewer_{n}" if n in ("event_logs", "stg_events", "enriched", "mart") else n,
          re.sub(r"\b(event_logs|stg_events|enriched)\b", r"fewer_\1", q).replace("FROM lineitem", "FROM lineitem WHERE l_linenumber > 2"))
         for n, q in O.base_ctes("lineitem")]
register("mart_partition_rewrite", O.with_(
    O.base_ctes("lineitem") + [c for c in FEWER if c[0].startswith("fewer_")], f"""
  SELECT *, 'old' AS version FROM mart
  UNION ALL SELECT *, 'new' FROM mart WHERE NOT ({IN_MONTH})
  UNION ALL SELECT *, 'new' FROM fewer_mart WHERE {IN_MONTH}"""))(_partition_rewrite)


REBUILD_BEFORE = _dt.date(1997, 1, 1)


def _rebuild(spark, d):
    """The marts are stored, then rebuilt from facts that lack all later months; those must go."""
    m = _m(spark, d, "lineitem")
    wh = JB.new_warehouse(spark)
    JB.build_marts(m, wh)
    left = m.event_logs.filter(F.col("start_time") < F.lit(REBUILD_BEFORE).cast("timestamp_ntz"))
    JB.build_marts(Models(spark, d, "lineitem", event_logs=left), wh)
    return JB.read_mart(spark, wh.mart_losses, S.MART_DAILY_LOSSES)


register("mart_rebuild_from_fewer_facts", O.with_(
    O.base_ctes("lineitem"), f"SELECT * FROM mart WHERE event_date < DATE '{REBUILD_BEFORE}'"))(_rebuild)


def _compacted(spark, d):
    """The event log appended in four runs, compacted, appended to once more, compacted again. Rows by
    month and operation, whether each file is sorted by the sort key, and whether a month is one folder."""
    facts, path = _m(spark, d, "lineitem").event_logs, fresh_dir(spark, "compacted")
    for i in range(5):
        ST.append(facts.filter(F.pmod(F.xxhash64("case_id"), F.lit(5)) == i), path, "event_logs")
        if i >= 3:
            ST.compact(spark, path, "event_logs", S.EVENT_LOGS)
    parts = SN.current(spark, path).of()
    rows = JB.read_event_logs(spark, path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    key = F.struct(*ST.SORT_KEYS["event_logs"])
    before = F.lag(key).over(Window.partitionBy("file").orderBy("at"))
    rows = rows.withColumn("unsorted", F.coalesce(before > key, F.lit(False)))
    return rows.groupBy("month", "operation_name").agg(
        F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"), F.count_if("unsorted").alias("unsorted"),
        F.lit(len(parts) == len({p.month for p in parts})).alias("one_folder_a_month"))


register("facts_compacted", O.with_(O.base_ctes("lineitem", upto="event_logs"), """
  SELECT strftime(start_time, '%Y%m') AS month, operation_name, count(*) AS n, cast(sum(duration_seconds) as bigint) AS seconds,
         cast(0 as bigint) AS unsorted, true AS one_folder_a_month FROM event_logs GROUP BY 1, 2"""))(_compacted)


def _retention(spark, d):
    wh = JB.new_warehouse(spark)
    path = wh.path("raw", "scada_telemetry")
    ST.append(_m(spark, d).telemetry, path, "scada_telemetry")
    JB.apply_retention(spark, path, RETENTION_ASOF)
    return JB.read_telemetry(spark, path).select(*[f.name for f in S.TELEMETRY.fields])


register("retention_telemetry", O.with_(O.telemetry_ctes("telemetry"), f"""
  SELECT * FROM telemetry
  WHERE date_trunc('second', ts) + INTERVAL 1 YEAR > TIMESTAMP '{RETENTION_ASOF:%Y-%m-%d %H:%M:%S}'"""))(_retention)

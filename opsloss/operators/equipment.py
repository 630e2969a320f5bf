"""Equipment health: telemetry daily stats (M4) and the health mart (M5).

All aggregates are algebraic (count, avg, min, max, stddev_pop, count_if),
so partial aggregation on the map side bounds the shuffle to one row per
group and map task, whatever the skew of a device or metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import issue_flag
from ..functions.rounding import round_n

STATS_KEYS = ["reading_date", "equipment_id", "equipment_name", "metric_name", "unit"]


def stats_aggregates() -> list[Column]:
    st = F.col("equipment_state")
    return [
        F.count(F.lit(1)).alias("reading_count"),
        F.avg("metric_value").alias("avg_value"),
        F.min("metric_value").alias("min_value"),
        F.max("metric_value").alias("max_value"),
        F.stddev_pop("metric_value").alias("stddev_value"),
        F.count_if(st == "warning").alias("warning_count"),
        F.count_if(st == "maintenance").alias("maintenance_count"),
        F.count_if(st == "idle").alias("idle_count"),
    ]


def telemetry_daily_stats(stg_telemetry: DataFrame) -> DataFrame:
    """M4 (E3, E8): per (date, device id/name, metric, unit)."""
    return stg_telemetry.groupBy(*STATS_KEYS).agg(*stats_aggregates())


def health_columns() -> list[Column]:
    return [
        *[F.col(c) for c in STATS_KEYS], F.col("reading_count"),
        *[round_n(c, 3).alias(c) for c in ("avg_value", "min_value", "max_value", "stddev_value")],
        F.col("warning_count"), F.col("maintenance_count"), F.col("idle_count"),
        issue_flag("warning_count", "maintenance_count").alias("has_issues"),
    ]


def mart_equipment_health(daily_stats: DataFrame) -> DataFrame:
    """M5 (F6, F8): rounded stats and the issue flag (warning + maintenance only, S14)."""
    return daily_stats.select(*health_columns())


def rounded_daily_stats(daily_stats: DataFrame) -> DataFrame:
    """M4 as a comparable table: float statistics rounded to 3 places."""
    return daily_stats.select(
        *STATS_KEYS, "reading_count",
        *[round_n(c, 3).alias(c) for c in ("avg_value", "min_value", "max_value", "stddev_value")],
        "warning_count", "maintenance_count", "idle_count",
    )

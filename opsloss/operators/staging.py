"""Staging models (B1-B4): clean, type and rename the raw inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .versioning import latest_by_key

# Staging bounds (equal the reference's): durations kept in (0, 86400) s,
# telemetry kept from quality 64 up.
MAX_DURATION = 86400
MIN_QUALITY = 64


def stg_event_logs(event_logs: DataFrame) -> DataFrame:
    """B1: keep ``0 < duration < 86400``; add ``event_date``."""
    d = F.col("duration_seconds")
    return event_logs.filter((d > 0) & (d < MAX_DURATION)).select(
        "case_id", "operation_name", "start_time", "end_time", "duration_seconds", "user_id",
        F.to_date("start_time").alias("event_date"),
    )


def stg_telemetry(telemetry: DataFrame) -> DataFrame:
    """B2: keep ``quality >= 64`` with a value; add ``reading_date``."""
    return telemetry.filter((F.col("quality") >= MIN_QUALITY) & F.col("metric_value").isNotNull()).select(
        "ts", "equipment_id", "equipment_name", "metric_name", "metric_value", "unit",
        "equipment_state", "source_system", "quality",
        F.to_date("ts").alias("reading_date"),
    )


def stg_norms(norms_versioned: DataFrame) -> DataFrame:
    """Latest version per id, ``id → norm_id``."""
    latest = latest_by_key(norms_versioned, "id")
    return latest.select(
        F.col("id").alias("norm_id"), "operation_name", "norm_seconds", "role_id"
    )


def stg_rates(rates_versioned: DataFrame) -> DataFrame:
    """Latest version per id, ``id → tariff_id``."""
    latest = latest_by_key(rates_versioned, "id")
    return latest.select(F.col("id").alias("tariff_id"), "role_name", "hourly_rate")

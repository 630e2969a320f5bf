"""Norm calibration (M14: B8, E6, F13, D4, F14).

Exact percentiles at scale: ``percentile``/``median`` aggregate a
value → count map per group, merged partially on the map side. Durations
that pass B8 are whole seconds in ``(0, 86400)``, so the map of one
operation never exceeds 86,399 entries however many events it has (a hot
operation with a third of all rows included). No sampling, no cap.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import ts_literal
from ..functions.expressions import percent_change, recommended_norm
from ..functions.rounding import round_n
from .joins import sized_broadcast
from .staging import MAX_DURATION

# Fixed value: default calibration lookback in days (equals the reference's).
LOOKBACK_DAYS = 30


def calibration_window(event_logs: DataFrame, asof: _dt.datetime, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """``start_time >= asof - lookback`` and ``0 < duration < 86400``."""
    from ..sources.storage import month_bound

    since = asof - _dt.timedelta(days=lookback_days)
    d = F.col("duration_seconds")
    return month_bound(event_logs, since).filter((F.col("start_time") >= ts_literal(since)) & (d > 0) & (d < MAX_DURATION))


def calibration_stats(window: DataFrame) -> DataFrame:
    """E6 + F13: count, mean, median, sample std, p75 (each to 1 decimal), recommendation.

    Statistics are rounded first and the recommendation is computed from
    the rounded median and std (S21); one-event operations have a NULL std
    and so a NULL recommendation (S22).
    """
    d = F.col("duration_seconds")
    agg = window.groupBy("operation_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(d).alias("_mean"),
        F.median(d).alias("_median"),
        F.stddev_samp(d).alias("_std"),
        F.percentile(d, 0.75).alias("_p75"),
    )
    r = agg.select(
        "operation_name", "event_count",
        round_n("_mean", 1).alias("mean_sec"),
        round_n("_median", 1).alias("median_sec"),
        round_n("_std", 1).alias("std_sec"),
        round_n("_p75", 1).alias("p75_sec"),
    )
    return r.withColumn("recommended_norm_sec", recommended_norm("median_sec", "std_sec"))


def norm_calibration(stats: DataFrame, norms_staged: DataFrame) -> DataFrame:
    """D4 + F14: stats ⟕ current norms; delta and percent change (NULL-safe, S23)."""
    cur = sized_broadcast(norms_staged.select(
        "operation_name", F.col("norm_seconds").alias("current_norm_sec")))
    j = stats.join(cur, "operation_name", "left")
    delta = F.col("recommended_norm_sec") - F.col("current_norm_sec")
    return j.select(
        *stats.columns, "current_norm_sec",
        delta.alias("delta_sec"),
        percent_change(delta, "current_norm_sec").alias("delta_pct"),
    )

"""Exact duration histograms: the loss mart (M3) and the calibration (M14) without the facts.

``(event_date, operation_name, duration_seconds, n)`` holds all that both need of the staged events. Durations
are whole seconds in (0, 86400), so the table has at most 86,399 rows for a date and operation; adding the
``n`` of two histograms gives the histogram of both. All sums below are over integers and exact.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import schemas as S
from ..functions.dates import month_key
from ..functions.expressions import clipped_delta_int, recommended_norm
from ..functions.rounding import round_n
from ..sources.snapshots import MONTH
from .joins import DEFAULT_MAX_BROADCAST_BYTES, sized_broadcast
from .losses import MART_KEYS, finish_mart

HISTOGRAM = StructType([StructField("event_date", S.DT), StructField("operation_name", S.S),
                        StructField("duration_seconds", S.I), StructField("n", S.L)])
KEYS = ["event_date", "operation_name", "duration_seconds"]


def daily_histogram(stg_events: DataFrame) -> DataFrame:
    """The histogram of staged events, with ``month``; map tasks send one row per key."""
    return (stg_events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
            .withColumn(MONTH, month_key("event_date")))


def merge(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS, MONTH).agg(F.sum("n").alias("n"))


def _moments() -> tuple[Column, Column, Column]:
    """Aggregates: count, sum of durations, sum of their squares (the last two as exact decimals)."""
    d, n = F.col("duration_seconds").cast("decimal(6,0)"), F.col("n").cast("decimal(20,0)")
    return F.sum("n"), F.sum((n * d).cast("decimal(28,0)")), F.sum((n * d * d).cast("decimal(33,0)"))


def _spread(count: str, total: str, squares: str) -> Column:
    """Sum of squared deviations from the mean, times the count: exact, so never negative."""
    c, t = F.col(count).cast("decimal(20,0)"), F.col(total)
    return (c * F.col(squares)).cast("decimal(38,0)") - (t * t).cast("decimal(38,0)")


def mart_daily_losses(hist: DataFrame, dims: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """M3 from a histogram: the same rows as ``losses.mart_daily_losses`` over the events."""
    d = sized_broadcast(dims.select("operation_name", "norm_seconds", "role_name", "hourly_rate"), max_bytes)
    count, total, squares = _moments()
    agg = hist.join(d, "operation_name").groupBy(*MART_KEYS).agg(
        count.alias("event_count"), total.alias("_total"), squares.alias("_squares"),
        F.sum(clipped_delta_int("duration_seconds", "norm_seconds") * F.col("n")).alias("_sum_delta"))
    agg = agg.withColumns({"_avg": F.col("_total").cast("double") / F.col("event_count"),
                           "_sd": F.sqrt(_spread("event_count", "_total", "_squares").cast("double")) / F.col("event_count")})
    return finish_mart(agg)


def calibration_stats(hist: DataFrame, asof: _dt.datetime, lookback_days: int = 30) -> DataFrame:
    """E6 from a histogram: ``calibration.calibration_stats`` of the events since ``asof - lookback_days``.

    Days are the histogram's grain, so ``asof`` must be a midnight. Only the months of the window are read;
    percentiles take ``n`` as frequency."""
    if asof.time() != _dt.time():
        raise ValueError("a histogram by day needs an asof at midnight")
    since = (asof - _dt.timedelta(days=lookback_days)).date()
    window = hist.filter((F.col("event_date") >= F.lit(since)) & (F.col(MONTH) >= F.lit(since.strftime("%Y%m"))))
    count, total, squares = _moments()
    d = F.col("duration_seconds").cast("double")
    s = window.groupBy("operation_name").agg(
        count.alias("event_count"), total.alias("_total"), squares.alias("_squares"),
        F.percentile(d, F.lit(0.5), F.col("n")).alias("_median"), F.percentile(d, F.lit(0.75), F.col("n")).alias("_p75"))
    c = F.col("event_count")
    var = F.try_divide(_spread("event_count", "_total", "_squares").cast("double"), (c * (c - 1)).cast("double"))
    s = s.select("operation_name", "event_count",
                 round_n(F.col("_total").cast("double") / c, 1).alias("mean_sec"), round_n("_median", 1).alias("median_sec"),
                 round_n(F.sqrt(var), 1).alias("std_sec"), round_n("_p75", 1).alias("p75_sec"))
    return s.withColumn("recommended_norm_sec", recommended_norm("median_sec", "std_sec"))

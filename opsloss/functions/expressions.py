"""Scalar expressions of the loss model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rounding import round_even, round_n

# Fixed value: rates are per hour, durations in seconds.
SECONDS_PER_HOUR = 3600.0


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clipped_delta(actual: Column | str, norm: Column | str) -> Column:
    """``max(actual - norm, 0)`` as a double."""
    return F.greatest(_c(actual).cast("double") - _c(norm).cast("double"), F.lit(0.0))


def clipped_delta_int(duration: Column | str, norm: Column | str) -> Column:
    """F2 on whole seconds, kept integral so sums are exact and order-free."""
    return F.greatest(_c(duration).cast("bigint") - _c(norm).cast("bigint"), F.lit(0).cast("bigint"))


def loss(delta_sec: Column | str, rate: Column | str) -> Column:
    """``delta / 3600 * rate``."""
    return _c(delta_sec).cast("double") / F.lit(SECONDS_PER_HOUR) * _c(rate)


def z_score(avg: Column | str, norm: Column | str, sd: Column | str) -> Column:
    """``(avg - norm) / sd`` when ``sd > 0``, else 0."""
    sd = _c(sd)
    return F.when(sd > 0, (_c(avg) - _c(norm).cast("double")) / sd).otherwise(F.lit(0.0))


def issue_flag(warning: Column | str, maintenance: Column | str) -> Column:
    """1 when a warning or maintenance reading was seen."""
    return F.when(_c(warning) + _c(maintenance) > 0, F.lit(1)).otherwise(F.lit(0))


def minutes(seconds: Column | str) -> Column:
    """seconds → minutes, 2 decimals."""
    return round_n(_c(seconds).cast("double") / F.lit(60.0), 2)


def recommended_norm(median: Column | str, std: Column | str) -> Column:
    """``round(median + 0.5 * std)`` as int, half-to-even; NULL if std is."""
    return round_even(_c(median) + F.lit(0.5) * _c(std), 0).cast("int")


def percent_change(delta: Column | str, base: Column | str) -> Column:
    """``delta / base * 100`` to 1 decimal; NULL when base is 0 or NULL."""
    return round_n(F.try_divide(_c(delta).cast("double"), _c(base).cast("double")) * F.lit(100.0), 1)

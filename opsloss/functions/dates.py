"""Date and time helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c



def month_key(c: Column | str) -> Column:
    """monthly partition key ``yyyyMM`` of a timestamp or date."""
    return F.date_format(col(c), "yyyyMM")


def week_start(c: Column | str) -> Column:
    """Monday of the ISO week that holds ``c``, as a date."""
    return F.to_date(F.date_trunc("week", col(c)))


def ts_literal(value: str | _dt.datetime | _dt.date) -> Column:
    """A naive (NTZ) timestamp literal."""
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    return F.to_timestamp_ntz(F.lit(str(value)))


def date_literal(value: str | _dt.date) -> Column:
    if isinstance(value, _dt.datetime):
        value = value.date()
    return F.to_date(F.lit(str(value)))


def parse_date_strict(value: str) -> _dt.date:
    """F16: strict ``yyyy-MM-dd`` parse of a job argument; raises on bad input."""
    return _dt.datetime.strptime(value, "%Y-%m-%d").date()


def try_parse_date(c: Column | str) -> Column:
    """F16 on a column: NULL where the text is not ``yyyy-MM-dd``."""
    return F.try_to_timestamp(col(c), F.lit("yyyy-MM-dd")).cast("date")


def previous_week_monday(today: _dt.date) -> _dt.date:
    """Monday of the week before the one that holds ``today``."""
    return today - _dt.timedelta(days=today.weekday() + 7)


def minus_hours(c: Column, hours: int) -> Column:
    return c - F.make_dt_interval(F.lit(0), F.lit(hours))


def plus_seconds(c: Column | str, secs: Column | str) -> Column:
    return F.timestamp_add("SECOND", col(secs), col(c))

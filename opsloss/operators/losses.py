"""Labour-cost losses: raw report (M1), event enrichment (M2), daily mart (M3).

Two loss formulas exist and both are kept (S1):

* raw:  ``max(avg(d) - norm, 0) / 3600 * rate * n``  (clip of the mean)
* mart: ``sum(max(d_i - norm, 0)) / 3600 * rate``    (clip of each event)

Plan shape at scale: the fact side is scanned with pruned columns and the
time predicate pushed into Parquet; the dimension join (norms ⋈ rates, a
few rows) is broadcast after a size check; the aggregation runs partial
aggregation on the map side, so one hash shuffle carries at most one row per
group and map task, whatever the skew of ``operation_name``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import minus_hours, ts_literal
from ..functions.expressions import clipped_delta, clipped_delta_int, loss, minutes, z_score
from ..functions.rounding import round_n
from .joins import DEFAULT_MAX_BROADCAST_BYTES, norms_with_rates, sized_broadcast


def dims_joined(norms_staged: DataFrame, rates_staged: DataFrame) -> DataFrame:
    """D1 on staged dims: one row per operation with its norm, role and rate."""
    return norms_with_rates(norms_staged, rates_staged)


# ---------------------------------------------------------------- M2 / M3

def ops_enriched(stg_events: DataFrame, dims: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """M2 (D3, F2, F3): each staged event with norm, role, rate, delta and loss.

    The two inner joins of the model (events ⋈ norms ⋈ rates) are done as
    norms ⋈ rates first (tiny) and one broadcast join onto the facts.
    """
    d = sized_broadcast(dims, max_bytes)
    j = stg_events.join(d, "operation_name", "inner")
    delta = clipped_delta("duration_seconds", "norm_seconds")
    return j.select(
        "case_id", "operation_name", "event_date", "start_time", "end_time",
        "duration_seconds", "user_id", "norm_seconds", "role_id", "role_name", "hourly_rate",
        delta.alias("delta_sec"),
        loss(delta, "hourly_rate").alias("loss"),
    )


MART_KEYS = ["event_date", "operation_name", "role_name", "hourly_rate", "norm_seconds"]


def mart_daily_losses(enriched: DataFrame) -> DataFrame:
    """M3 (E2, F5, F8): one row per (date, operation, role, rate, norm).

    Loss is summed as whole seconds and multiplied once (§4 shortcut): the
    integer sum is exact and order-free, so the result does not depend on
    partitioning. ``z`` uses the population stddev of the group, unrounded.
    """
    return finish_mart(enriched.groupBy(*MART_KEYS).agg(*mart_aggregates()))


def mart_aggregates() -> list[Column]:
    """What ``finish_mart`` needs of the enriched events of one ``MART_KEYS`` group."""
    return [
        F.count(F.lit(1)).alias("event_count"),
        F.avg("duration_seconds").alias("_avg"),
        F.stddev_pop("duration_seconds").alias("_sd"),
        F.sum(clipped_delta_int("duration_seconds", "norm_seconds")).alias("_sum_delta"),
    ]


def mart_columns() -> list[Column]:
    """The mart's columns over ``MART_KEYS`` and ``mart_aggregates``."""
    return [
        F.col("event_date"), F.col("operation_name"), F.col("role_name"), F.col("event_count"),
        round_n("_avg", 2).alias("avg_duration_sec"),
        F.col("norm_seconds"), F.col("hourly_rate"),
        round_n(F.col("_sum_delta") / F.col("event_count"), 2).alias("delta_sec"),
        round_n(loss("_sum_delta", "hourly_rate"), 2).alias("total_loss"),
        round_n(z_score("_avg", "norm_seconds", "_sd"), 3).alias("z_score"),
    ]


def finish_mart(agg: DataFrame) -> DataFrame:
    """The mart's rows from its groups."""
    return agg.select(*mart_columns())


# ---------------------------------------------------------------- M1

def raw_window(event_logs: DataFrame, report_ts, bounded: bool = False) -> DataFrame:
    """Events with ``start_time >= report_ts - 24h``.

    The reference window has no upper bound (S3); ``bounded=True`` adds
    ``start_time < report_ts`` as an opt-in.
    """
    from ..sources.storage import month_bound

    r = ts_literal(report_ts)
    cond = F.col("start_time") >= minus_hours(r, 24)
    if bounded:
        cond = cond & (F.col("start_time") < r)
    since = report_ts - _dt.timedelta(hours=24)
    return month_bound(event_logs, since, report_ts if bounded else None).filter(cond)


def calculate_losses(per_op: DataFrame, dims: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Per-operation aggregates ⋈ norms → losses, sorted.

    ``per_op`` has ``operation_name, event_count, avg_duration_sec,
    total_duration_sec`` (and optionally grouping columns such as
    ``report_date``, carried through).
    """
    d = sized_broadcast(dims.select("operation_name", "norm_seconds", "hourly_rate", "role_name"), max_bytes)
    j = per_op.join(d, "operation_name", "inner")
    delta = clipped_delta("avg_duration_sec", "norm_seconds")
    per_event = loss(delta, "hourly_rate")
    extra = [c for c in per_op.columns if c not in
             ("operation_name", "event_count", "avg_duration_sec", "total_duration_sec")]
    out = j.select(
        *extra,
        "operation_name", "event_count", "avg_duration_sec", "total_duration_sec",
        "norm_seconds", "hourly_rate", "role_name",
        delta.alias("delta_sec"),
        per_event.alias("loss_per_event"),
        round_n(per_event * F.col("event_count"), 2).alias("total_loss"),
        minutes("avg_duration_sec").alias("avg_duration_min"),
        minutes("norm_seconds").alias("norm_min"),
    )
    return out.orderBy(*[F.col(c) for c in extra], F.desc("total_loss"), F.asc("operation_name"))


def aggregate_per_operation(events: DataFrame, *group: str) -> DataFrame:
    """Count, mean and sum of durations per operation (aggregate before join)."""
    return events.groupBy(*group, "operation_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg("duration_seconds").alias("avg_duration_sec"),
        F.sum("duration_seconds").cast("bigint").alias("total_duration_sec"),
    )


def daily_losses_raw(event_logs: DataFrame, dims: DataFrame, report_ts, bounded: bool = False) -> DataFrame:
    """M1: raw-mode losses for one report time (no duration filter, S2)."""
    return calculate_losses(aggregate_per_operation(raw_window(event_logs, report_ts, bounded)), dims)


def daily_losses_raw_by_day(event_logs: DataFrame, dims: DataFrame) -> DataFrame:
    """M1 for every date at once, with the opt-in upper bound.

    Report ``R`` (midnight) covers ``[R - 24h, R)``, i.e. the calendar day
    before ``R``; the many-date form is a plain group by that day.
    """
    ev = event_logs.withColumn("report_date", F.date_add(F.to_date("start_time"), 1))
    return calculate_losses(aggregate_per_operation(ev, "report_date"), dims)


def per_operation_since(event_logs: DataFrame) -> DataFrame:
    """E1 for every report date, window without upper bound (S3): ``report_date``, operation, count, mean, sum.

    Report ``R`` (midnight) covers all events from the day before ``R`` on. Events are first reduced to one partial row
    for each operation and day; a window that runs from the last day back adds them up (counts and sums
    of days are additive, so this is exact), and a day's row stands for all report days back to the operation's
    day before it. Report dates run from the day after the first event to the day after the last one. No event is paired
    with report dates; an operation's window holds its days, however many events they have.
    """
    days = (event_logs.withColumn("_day", F.to_date("start_time")).filter(F.col("_day").isNotNull())
            .groupBy("operation_name", "_day")
            .agg(F.count(F.lit(1)).alias("_n"), F.count("duration_seconds").alias("_timed"),
                 F.sum("duration_seconds").alias("_total")))
    first = days.agg(F.min("_day").alias("_first"))
    back = Window.partitionBy("operation_name").orderBy(F.desc("_day"))
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = days.withColumns({"_n": F.sum("_n").over(upto), "_timed": F.sum("_timed").over(upto),
                              "_total": F.sum("_total").over(upto), "_before": F.lead("_day").over(back)})
    gap = F.sequence(F.date_add(F.coalesce("_before", F.date_sub("_first", 1)), 1), F.col("_day"))
    return since.crossJoin(F.broadcast(first)).select(          # one row on the right
        F.explode(gap).alias("_d"), "operation_name", "_n", "_timed", "_total").select(
        F.date_add("_d", 1).alias("report_date"), "operation_name", F.col("_n").alias("event_count"),
        F.try_divide(F.col("_total").cast("double"), F.col("_timed").cast("double")).alias("avg_duration_sec"),
        F.col("_total").cast("bigint").alias("total_duration_sec"))


def daily_losses_raw_every_date(event_logs: DataFrame, dims: DataFrame) -> DataFrame:
    """M1 for every report date at once, with the reference's unbounded window."""
    return calculate_losses(per_operation_since(event_logs), dims)

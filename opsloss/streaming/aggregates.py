"""Structured Streaming forms of the daily models.

Both streams keep no state: each micro-batch adds its partial aggregates to a table (``partials``), and the
marts are made from the merged partials. Event time needs no watermark, late days just add to their
month. On the same rows the result equals the batch models.

* Health (J3): per key count, sum, squared deviations from the batch's own mean, extremes and state counts;
  merging shifts the deviations to the common mean (no cancellation of large squares).
* Losses (J4): an exact histogram (date, operation, duration, n). Durations are whole seconds below a day, so
  an operation has at most 86,399 rows a date however many events it has. No norm and no rate is part of it:
  marts follow today's dimensions (S18), and ``refresh_losses`` restates the dates of an operation whose norm,
  role or rate changed from the histogram alone. Calibration reads the same histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .. import schemas as S
from ..functions.expressions import issue_flag
from ..functions.rounding import round_n
from ..operators import histogram as H
from ..operators.equipment import STATS_KEYS
from ..operators.staging import stg_event_logs, stg_telemetry
from ..session import fresh_dir
from ..sources import snapshots as SN
from ..sources.adapters import events_to_event_logs, events_to_telemetry
from ..sources.snapshots import MONTH
from ..functions.dates import month_key
from . import partials as P


def file_stream(spark: SparkSession, directory: str, schema, glob: str = "*.parquet",
                max_files: int | None = None) -> DataFrame:
    """Parquet file stream over a landing folder with a fixed schema."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(directory)


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events", max_files: int | None = None) -> DataFrame:
    """File stream over one provided table (schema taken from the files once, then fixed)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return file_stream(spark, sf_dir, schema, f"{name}.parquet", max_files)


# ---------------------------------------------------------------- J3

COUNTED = ["warning_count", "maintenance_count", "idle_count"]
HEALTH_PARTIAL = StructType(
    [f for f in S.MART_EQUIPMENT_HEALTH.fields if f.name in STATS_KEYS]
    + [f for f in S.MART_EQUIPMENT_HEALTH.fields if f.name in ("reading_count", "min_value", "max_value", *COUNTED)]
    + [StructField("total", S.D), StructField("spread", S.D)])


def health_partial(readings: DataFrame) -> DataFrame:
    """E3 of one micro-batch: per key count, sum, squared deviations from its mean, extremes, state counts."""
    st = F.col("equipment_state")
    return (stg_telemetry(readings).groupBy(*STATS_KEYS)
            .agg(F.count(F.lit(1)).alias("reading_count"),
                 F.min("metric_value").alias("min_value"),
                 F.max("metric_value").alias("max_value"),
                 *[F.count_if(st == c.removesuffix("_count")).alias(c) for c in COUNTED],
                 F.sum("metric_value").alias("total"),
                 (F.var_pop("metric_value") * F.count(F.lit(1))).alias("spread"))
            .withColumn(MONTH, month_key("reading_date")))


def merge_health(parts: DataFrame) -> DataFrame:
    """One partial row per key. The common mean comes from a window over a key's few partials; the final sums use
    the same partitioning, so there is one shuffle."""
    w = Window.partitionBy(*STATS_KEYS, MONTH)
    n, total = F.col("reading_count"), F.col("total")
    off = total / n - F.sum(total).over(w) / F.sum(n).over(w)
    return (parts.withColumn("spread", F.col("spread") + n * off * off)
            .groupBy(*STATS_KEYS, MONTH)
            .agg(F.sum("reading_count").alias("reading_count"), F.min("min_value").alias("min_value"),
                 F.max("max_value").alias("max_value"), *[F.sum(c).alias(c) for c in COUNTED],
                 F.sum("total").alias("total"), F.sum("spread").alias("spread")))


def run_health(telemetry: DataFrame, out_dir: str, processing_time: str | None = None, fold_at: int = P.FOLD):
    """Add the new readings of a telemetry stream to the partials under ``out_dir``."""
    return P.run(telemetry, f"{out_dir}/partials", f"{out_dir}/_checkpoint", health_partial, merge_health,
                 HEALTH_PARTIAL, processing_time, fold_at)


def health_mart(spark: SparkSession, out_dir: str) -> DataFrame:
    """The health mart of all readings that the stream writing to ``out_dir`` has taken in."""
    m = merge_health(P.read(spark, f"{out_dir}/partials", HEALTH_PARTIAL))
    n = F.col("reading_count")
    m = m.withColumns({"avg_value": F.col("total") / n, "stddev_value": F.sqrt(F.col("spread") / n)})
    return m.select(
        *STATS_KEYS, "reading_count",
        *[round_n(c, 3).alias(c) for c in ("avg_value", "min_value", "max_value", "stddev_value")],
        *COUNTED, issue_flag("warning_count", "maintenance_count").alias("has_issues"),
    )


def stream_equipment_health(spark: SparkSession, sf_dir: str, out_dir: str | None = None) -> DataFrame:
    """J3 end to end: run the stream to completion, return the health mart it built."""
    out_dir = out_dir or fresh_dir(spark, "stream_health")
    run_health(events_to_telemetry(event_stream(spark, sf_dir)), out_dir)
    return health_mart(spark, out_dir)


# ---------------------------------------------------------------- J4

DIMS = StructType([StructField("operation_name", S.S), StructField("norm_seconds", S.I),
                   StructField("role_name", S.S), StructField("hourly_rate", S.D)])


def run_losses(event_logs: DataFrame, out_dir: str, processing_time: str | None = None, fold_at: int = P.FOLD):
    """Add the new events of an event-log stream to the histogram under ``out_dir``."""
    return P.run(event_logs, f"{out_dir}/partials", f"{out_dir}/_checkpoint",
                 lambda rows: H.daily_histogram(stg_event_logs(rows)), H.merge, H.HISTOGRAM, processing_time, fold_at)


def histogram(spark: SparkSession, out_dir: str, months: list[str] | None = None) -> DataFrame:
    """date, operation, duration, n of all events taken in (a key may have several rows)."""
    return P.read(spark, f"{out_dir}/partials", H.HISTOGRAM, months)


def refresh_losses(spark: SparkSession, out_dir: str, dims: DataFrame) -> dict[str, int]:
    """Bring the stored loss mart up to date with the histogram and today's dimensions.

    Recomputed are the (date, operation) rows that new partials touch, and all dates of operations whose norm, role or rate differs
    from the one the mart was made with (including operations that gained or lost a norm). Months with such rows are
    written anew from the histogram, the others keep their folders; dimensions and marts become visible together.
    Returns how many keys and months were recomputed."""
    root, source = f"{out_dir}/mart", f"{out_dir}/partials"
    base, now = SN.current(spark, root), SN.current(spark, source)
    dims = dims.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DIMS.fields])
    before = SN.read(spark, root, DIMS, "dims", at=base)
    changed = dims.exceptAll(before).unionByName(before.exceptAll(dims)).select("operation_name").distinct()
    used = set(base.notes.get("partials", []))
    fresh = SN.Snapshot(now.number, tuple(p for p in now.parts if p.path not in used))
    every = P.read(spark, source, H.HISTOGRAM, at=now)
    columns = [MONTH, "event_date", "operation_name"]
    keys = (P.read(spark, source, H.HISTOGRAM, at=fresh).select(*columns)
            .unionByName(every.join(changed, "operation_name", "left_semi").select(*columns)).distinct())
    path = fresh_dir(spark, "loss_keys")
    keys.write.parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    months = sorted(r[0] for r in keys.select(MONTH).distinct().collect())       # months, not rows
    on = ["event_date", "operation_name"]
    touched = P.read(spark, source, H.HISTOGRAM, months, now).join(keys.select(*on), on, "left_semi")
    old = SN.Snapshot(base.number, tuple(p for p in base.of() if p.month in months))
    kept = SN.read(spark, root, S.MART_DAILY_LOSSES, at=old).join(keys.select(*on), on, "left_anti")
    rows = kept.unionByName(H.mart_daily_losses(touched, dims)).withColumn(MONTH, month_key("event_date"))
    parts = SN.stage(rows.hint("rebalance", MONTH).sortWithinPartitions(*on), root, (MONTH,)) if months else []
    parts += SN.stage(dims, root, kind="dims")
    SN.publish(spark, root, base, (*[p for p in base.of() if p.month not in months], *parts),
               {"partials": sorted(p.path for p in now.parts)})
    return {"keys": keys.count(), "months": len(months)}


def losses_mart(spark: SparkSession, out_dir: str) -> DataFrame:
    """The loss mart as of the last ``refresh_losses``."""
    return SN.read(spark, f"{out_dir}/mart", S.MART_DAILY_LOSSES)


def stream_daily_losses(spark: SparkSession, sf_dir: str, dims: DataFrame, out_dir: str | None = None) -> DataFrame:
    """J4 end to end; the result has the mart's columns and values."""
    out_dir = out_dir or fresh_dir(spark, "stream_losses")
    run_losses(events_to_event_logs(event_stream(spark, sf_dir)), out_dir)
    refresh_losses(spark, out_dir, dims)
    return losses_mart(spark, out_dir)

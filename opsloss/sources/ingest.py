"""Ingest of request bodies (A1-A4), batch and streamed alike.

A request is one JSON line ``{"batch_id": n, "rows": [...]}`` (events) or
``{"batch_id": n, "readings": [...]}`` (telemetry). Lines are parsed with a
fixed schema in PERMISSIVE mode and each batch is judged as a whole (S28: one
bad or incomplete row rejects the batch). An optional field may be missing
and then takes its default, but an explicit ``null`` in it is invalid; the
typed parse cannot tell the two apart, so such lines are looked at once more as VARIANT.
Accepted batches become rows, rejected ones a single record, in one
``explode``; no deduplication (S20). Everything is row-parallel: no group,
no shuffle on the ingest path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from .. import schemas as S
from ..functions.dates import month_key
from .snapshots import KIND, MONTH, ROW

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_OPTIONS = {"timestampNTZFormat": TS_FORMAT, "timestampFormat": TS_FORMAT}
PARSE_OPTIONS = JSON_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT}

TABLES = {"events": "event_logs", "readings": "scada_telemetry"}
FIELD = {"events": "rows", "readings": "readings"}
SCHEMA = {"events": S.EVENT_BATCH, "readings": S.READING_BATCH}
REQUIRED = {"events": S.EVENT_REQUIRED, "readings": S.READING_REQUIRED}
DEFAULTS: dict[str, dict] = {"events": {}, "readings": S.READING_DEFAULTS}
STORED = {"events": S.EVENT_LOGS, "readings": S.TELEMETRY}
TIME = {"events": "start_time", "readings": "ts"}

BATCH = StructType([StructField("batch_id", LongType()), StructField("batch_part", LongType()),
                    StructField("reject_reason", StringType()), StructField("row_count", LongType())])
FILES = StructType([StructField("path", StringType()), StructField("bytes", LongType()),
                    StructField("changed", TimestampType())])


# ---------------------------------------------------------------- reading

def request_files(spark: SparkSession, batch_dir: str) -> DataFrame:
    """path, bytes, changed of the files in a landing folder (a listing; no file is opened)."""
    listed = spark.read.format("binaryFile").load(batch_dir)
    return listed.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path)


# ---------------------------------------------------------------- judging

def parse(lines: DataFrame, kind: str) -> DataFrame:
    """One row per request: the batch schema's columns and the line itself; blank lines are skipped."""
    batch = F.from_json("value", SCHEMA[kind], PARSE_OPTIONS)
    return lines.filter(F.trim("value") != "").select(batch.alias("b"), "value").select("b.*", "value")


def explicit_null(kind: str) -> Column:
    """The line has a ``null`` in an optional field of some row. Only lines with the word are parsed again."""
    if not DEFAULTS[kind]:
        return F.lit(False)
    any_of = " OR ".join(f"is_variant_null(try_variant_get(r, '$.{f}', 'variant'))" for f in DEFAULTS[kind])
    found = f"exists(try_variant_get(try_parse_json(value), '$.{FIELD[kind]}', 'array<variant>'), r -> {any_of})"
    return F.col("value").contains("null") & F.coalesce(F.expr(found), F.lit(False))


def reject_reason(kind: str) -> Column:
    """A3/A4: why a batch is rejected, or NULL when it is accepted."""
    arr = F.col(FIELD[kind])
    missing = F.exists(arr, lambda r: reduce(lambda a, b: a | b, [r[c].isNull() for c in REQUIRED[kind]]))
    return (F.when(F.col(S.CORRUPT).isNotNull(), F.lit("corrupt"))
             .when(arr.isNull() | (F.size(arr) == 0), F.lit("empty"))
             .when(missing, F.lit("missing_required"))
             .when(explicit_null(kind), F.lit("null_value")))


def validated(lines: DataFrame, kind: str) -> DataFrame:
    """The requests with ``reject_reason``."""
    return parse(lines, kind).withColumn("reject_reason", reject_reason(kind)).drop("value")


# ---------------------------------------------------------------- rows

# Precision of the stored time columns (seconds for the event
# log, milliseconds for telemetry); finer input is truncated on ingest.
TIME_PRECISION = {"start_time": "second", "end_time": "second", "ts": "millisecond"}


def to_storage_precision(df: DataFrame) -> DataFrame:
    """Truncate time columns to the precision of the stored table (UTC session,
    so the round trip through TIMESTAMP keeps the wall-clock value)."""
    for c, unit in TIME_PRECISION.items():
        if c in df.columns:
            df = df.withColumn(c, F.date_trunc(unit, F.col(c).cast("timestamp")).cast("timestamp_ntz"))
    return df


def _item(kind: str, label: str, row: Column | None, reason: Column | None = None, size: Column | None = None) -> Column:
    """One record: the batch's columns, the stored table's columns."""
    batch = {"batch_id": F.col("batch_id"), "batch_part": F.col("batch_part"), "reject_reason": reason, "row_count": size}
    fields = [F.lit(label).alias(KIND)]
    fields += [(F.lit(None) if batch[f.name] is None else batch[f.name]).cast(f.dataType).alias(f.name) for f in BATCH.fields]
    for f in STORED[kind].fields:
        value = F.lit(None) if row is None else row[f.name]
        if row is not None and f.name in DEFAULTS[kind]:
            value = F.coalesce(value, F.lit(DEFAULTS[kind][f.name]))
        fields.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def items(batches: DataFrame, kind: str) -> DataFrame:
    """One record per accepted row, one per rejected batch, with ``kind`` and ``month`` (a single pass)."""
    field = FIELD[kind]
    rows = F.transform(F.col(field), lambda r: _item(kind, ROW, r))
    reject = _item(kind, "reject", None, F.col("reject_reason"), F.coalesce(F.size(field), F.lit(0)))
    out = batches.select(F.explode(F.when(F.col("reject_reason").isNull(), rows).otherwise(F.array(reject))).alias("i"))
    return to_storage_precision(out.select("i.*")).withColumn(MONTH, month_key(TIME[kind]))


def accepted(batches: DataFrame, kind: str) -> DataFrame:
    """A1/A2: rows of accepted batches, defaults filled, in the stored table's schema."""
    ok = batches.filter(F.col("reject_reason").isNull())
    rows = ok.select(F.explode(F.transform(F.col(FIELD[kind]), lambda r: _item(kind, ROW, r))).alias("i")).select("i.*")
    return to_storage_precision(rows.select(*[f.name for f in STORED[kind].fields]))


def rejected(batches: DataFrame, kind: str) -> DataFrame:
    """A3/A4: one row per rejected batch with its reason and size."""
    return batches.filter(F.col("reject_reason").isNotNull()).select(
        "batch_id", "batch_part", "reject_reason",
        F.coalesce(F.size(FIELD[kind]), F.lit(0)).cast("bigint").alias("row_count"))


def ingest_report(batches: DataFrame, kind: str) -> DataFrame:
    """A3: per batch, ``inserted`` rows (0 when rejected)."""
    ok = F.col("reject_reason").isNull()
    return batches.select("batch_id", "batch_part", ok.alias("accepted"),
                          F.when(ok, F.size(FIELD[kind])).otherwise(F.lit(0)).cast("bigint").alias("inserted"))

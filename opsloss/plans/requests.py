"""Request files for the registered ingest queries, made from the ``events`` table.

In production the requests come from outside; nothing in ``sources`` or ``streaming`` uses this module.
A request holds the rows of ``ROWS`` consecutive event ids. Some requests are invalid on purpose, by their number (fixed
parameters below): cut off, without rows, or with an explicit null where a field may only be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.adapters import events_to_event_logs, events_to_telemetry
from ..sources.ingest import JSON_OPTIONS

ROWS = 100
# Fixed parameters: a request with number n is cut off when n mod 17 = 7, empty when n mod 13 = 5, and written with
# its nulls when n mod 11 = 3.
CUT, EMPTY, NULLS = (17, 7), (13, 5), (11, 3)


def _is(rule: tuple[int, int]):
    return F.pmod(F.col("batch_id"), F.lit(rule[0])) == rule[1]


def _write(rows: DataFrame, field: str, fields: list[str], out_dir: str) -> None:
    grouped = rows.groupBy("batch_id").agg(F.collect_list(F.struct(*fields)).alias(field))
    body = F.when(_is(EMPTY), F.slice(field, 1, 0)).otherwise(F.col(field)).alias(field)
    made = grouped.select("batch_id", F.lit(0).cast("bigint").alias("batch_part"), body)
    whole = F.struct("batch_id", "batch_part", field)
    line = F.when(_is(NULLS), F.to_json(whole, JSON_OPTIONS | {"ignoreNullFields": "false"})).otherwise(F.to_json(whole, JSON_OPTIONS))
    out = made.select("batch_id", line.alias("value"))
    cut = F.when(_is(CUT), F.expr("substring(value, 1, length(value) - 3)")).otherwise(F.col("value"))
    out.select(cut.alias("value")).write.mode("append").text(out_dir)


def write_event_requests(events: DataFrame, out_dir: str) -> None:
    """Requests for the event endpoint."""
    src = events.withColumn("batch_id", F.expr(f"event_id div {ROWS}"))
    _write(events_to_event_logs(src, keep=("batch_id",)), "rows", [f.name for f in S.EVENT_ROW.fields], out_dir)


def write_reading_requests(events: DataFrame, out_dir: str) -> None:
    """Requests for the telemetry endpoint; optional fields equal to their default are left out."""
    src = events.withColumn("batch_id", F.expr(f"event_id div {ROWS}"))
    rows = events_to_telemetry(src, keep=("batch_id",))
    for name, default in S.READING_DEFAULTS.items():
        rows = rows.withColumn(name, F.when(F.col(name) != F.lit(default), F.col(name)))
    rows = rows.withColumn("quality", F.col("quality").cast("int"))
    _write(rows, "readings", [f.name for f in S.READING.fields], out_dir)

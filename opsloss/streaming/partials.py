"""Additive partials: what each micro-batch adds to a mart, as a snapshot table.

A stream that keeps its marts in Spark's state store needs state as large as the marts. Here the
stream is stateless: every micro-batch is aggregated by itself and its rows are appended to a table of partial
aggregates, one pointer per micro-batch, with the batch's number in the pointer. A batch that is repeated after a failure finds
its number there and adds nothing. Partials of a month are merged (``fold``) once they lie in more than ``FOLD``
folders; merging partials gives a partial again, so the table stays within the size of its distinct
keys plus a few batches, and late rows of any age simply add to their day.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources import snapshots as SN
from ..sources.snapshots import MONTH

FOLD = 8
Merge = Callable[[DataFrame], DataFrame]


def run(rows: DataFrame, root: str, checkpoint: str, partial: Merge, merge: Merge, schema: StructType,
        processing_time: str | None = None, fold_at: int = FOLD):
    """Drain ``rows`` (a stream) into the partials under ``root``. ``partial``: rows to partial rows with ``month``;
    ``merge``: partial rows to one row per key. With ``processing_time`` the stream keeps running and the started query is
    returned."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = SN.current(spark, root)
        done = base.notes.get("streams", {})
        if done.get(checkpoint, -1) >= number:
            return
        parts = SN.stage(partial(batch), root, (MONTH,))
        SN.publish(spark, root, base, (*base.parts, *parts), {"streams": done | {checkpoint: number}})
        fold(spark, root, merge, schema, fold_at)

    writer = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    if processing_time:
        return writer.trigger(processingTime=processing_time).start()
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return None


def read(spark: SparkSession, root: str, schema: StructType, months: list[str] | None = None, at: SN.Snapshot | None = None) -> DataFrame:
    """The partial rows (several a key), of some months or all."""
    now = at or SN.current(spark, root)
    if months is not None:
        now = SN.Snapshot(now.number, tuple(p for p in now.parts if p.month in months), now.notes)
    return SN.read(spark, root, schema, with_month=True, at=now)


def fold(spark: SparkSession, root: str, merge: Merge, schema: StructType, fold_at: int = FOLD) -> list[str]:
    """Merge the months that lie in more than ``fold_at`` folders; those months."""
    base = SN.current(spark, root)
    count = Counter(p.month for p in base.parts)
    months = sorted(m for m, n in count.items() if n > fold_at)
    if months:
        rows = merge(read(spark, root, schema, months, base)).select(*[f.name for f in schema.fields], MONTH)
        parts = SN.stage(rows.hint("rebalance", MONTH), root, (MONTH,))
        SN.publish(spark, root, base, (*[p for p in base.parts if p.month not in months], *parts), base.notes)
    return months

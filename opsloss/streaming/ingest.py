"""Streaming ingest of request bodies.

The request files land in a folder; one file stream reads their lines and
judges whole batches exactly like the batch path (``sources.ingest``). Rows and reject records go
through Spark's exactly-once file sink into one table partitioned by
``kind`` (``row`` / ``reject``) and ``month``. The files are read once;
readers go through the table root so the sink's commit log decides which
files are visible, and filter on ``kind`` (partition pruning). The
checkpoint lives under the shared folder, so a restarted job resumes
without duplicates.

Every run reports what it took in (A3): the counts are observed metrics of the
micro-batches themselves, summed up by a streaming listener, so nothing is read again for them.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StringType, StructField, StructType

from ..sources import ingest as I
from ..sources.snapshots import KIND, MONTH, ROW

COUNTS = "ingest_counts"


class _Counts(StreamingQueryListener):
    """Sums the observed counts of one query's micro-batches."""

    def __init__(self):
        self.total = {"batches": 0, "inserted": 0, "rejected_batches": 0}
        self.query, self.seen, self.ended = None, set(), threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        found = (p.observedMetrics or {}).get(COUNTS)
        if found is not None and (str(p.runId), p.batchId) not in self.seen:
            self.seen.add((str(p.runId), p.batchId))
            self.total["batches"] += 1
            self.total["inserted"] += found["rows"] or 0
            self.total["rejected_batches"] += found["rejects"] or 0

    def onQueryTerminated(self, event):
        if self.query in (None, str(event.runId)):
            self.ended.set()


def counted(items: DataFrame) -> DataFrame:
    is_row = F.col(KIND) == ROW
    return items.observe(COUNTS, F.count_if(is_row).alias("rows"), F.count_if(~is_row).alias("rejects"))


def stream_ingest(spark: SparkSession, batch_dir: str, out_dir: str, kind: str = "events",
                  max_files: int | None = None) -> tuple[str, dict[str, int]]:
    """Take in what has arrived since the last run over ``out_dir``; the table root (read with ``ingested_rows`` /
    ``ingested_rejects``) and this run's ``{"batches": micro-batches, "inserted": rows, "rejected_batches": n}``."""
    # a session of its own, so that the listener hears this query only
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        session.conf.set(key, spark.conf.get(key))
    reader = session.readStream if not max_files else session.readStream.option("maxFilesPerTrigger", max_files)
    items = counted(I.items(I.validated(reader.text(batch_dir), kind), kind))
    root, heard = f"{out_dir}/ingested", _Counts()
    session.streams.addListener(heard)
    try:
        query = (items.writeStream.format("parquet").option("path", root)
                 .option("checkpointLocation", f"{out_dir}/_checkpoint")
                 .partitionBy(KIND, MONTH).outputMode("append").trigger(availableNow=True).start())
        heard.query = str(query.runId)
        query.awaitTermination()
        heard.ended.wait(60)            # events come in order: after the last one all counts are in
    finally:
        session.streams.removeListener(heard)
    return root, heard.total


def _read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    full = StructType(list(I.BATCH.fields) + list(I.STORED[kind].fields)
                      + [StructField(KIND, StringType()), StructField(MONTH, StringType())])
    return spark.read.schema(full).parquet(root)


def ingested_rows(spark: SparkSession, root: str, kind: str = "events") -> DataFrame:
    """Accepted rows in the table schema, with ``month``."""
    rows = _read(spark, root, kind).filter(F.col(KIND) == ROW)
    return rows.select(*[f.name for f in I.STORED[kind].fields], MONTH)


def ingested_rejects(spark: SparkSession, root: str, kind: str = "events") -> DataFrame:
    return _read(spark, root, kind).filter(F.col(KIND) == "reject").select(*[f.name for f in I.BATCH.fields])


def rows_stream(spark: SparkSession, root: str, kind: str = "events") -> DataFrame:
    """The accepted rows of a streaming ingest as a stream of their own, in the stored table's schema."""
    full = StructType(list(I.STORED[kind].fields) + [StructField(KIND, StringType()), StructField(MONTH, StringType())])
    rows = spark.readStream.schema(full).parquet(root).filter(F.col(KIND) == ROW)
    return rows.select(*[f.name for f in I.STORED[kind].fields])

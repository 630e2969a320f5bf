"""Exact dedup as a stateful stream: keyed state on disk, without expiry; bytes compared on every hit.

``ingest`` reads new files of a folder as a stream in two steps that a checkpoint makes rerunnable:

* ``index``: for every row its doc_id, SHA-256 digest and content locator (file and row number), appended
  by the exactly-once file sink. The texts themselves are not stored again.
* ``groups``: a streaming aggregation by digest in RocksDB state stores, which keep their entries on the
  executors' disks and their changes in the shared checkpoint folder. State per digest, for ever: the
  stable identifier of the row that stays (the largest doc_id, then the largest locator), its locator and
  the number of rows. Every micro-batch writes the entries it touched into a folder of its own; a
  repeated batch replaces its folder, and the entry with most rows is the current one.

A later call goes on from the checkpoints, so new files meet all digests seen before.

``compare`` checks whole texts: each row that hit an entry is compared, by full text, with the text at the
entry's locator. A bit map of fixed size over the digests with hits keeps all other texts out of the
shuffle. Digests under which texts differ (``resolve``) are grouped anew by the text itself, so equal
digests never make unlike texts equal.

All of it is DataFrame code: no Python worker takes part. A digest with a third of all rows sends one row
from each task to the state, and its texts meet their keeper in a join that AQE splits.

Defined cases: a null text is the empty text; rows that repeat a doc_id are rows of their own, and one of
them stays (the last by file and row number); a null doc_id is smaller than all others; other columns are
never read; an empty folder gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloss.llm.common import cut
from opsloss.session import fresh_dir, path_exists

BITS = 1 << 24              # of the map over digests with hits
STATE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",      # no 4 MB set aside for each partition's store
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
         "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256"}
WIDTH = 32                  # bytes of the SHA-256 that key the state
INDEX = "doc_id long, sha256 binary, file string, row long"
ENTRY = "digest binary, size long, keep struct<doc_id: long, file: string, row: long>"
FILES = 1000                # files of a micro-batch


def sha256(text):
    return F.unhex(F.sha2(text, 256))


def key(width: int):
    """The state's key: the first ``width`` bytes of the digest."""
    return F.expr(f"substring(sha256, 1, {width})").alias("digest")


def content(reader, path: str) -> DataFrame:
    """doc_id, text, file and row number of a folder (or file) of documents, streamed or not."""
    docs = reader.schema("doc_id long, text string").parquet(path)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _drain(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def ingest(spark: SparkSession, path: str, folder: str, width: int = WIDTH, files: int = FILES) -> None:
    """Take the files that are new under ``path`` into the index and the state kept under ``folder``."""
    session = spark.newSession()        # its own settings: no other query sees the state store's
    for k, v in (STATE | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                          "spark.sql.session.timeZone": "UTC"}).items():
        session.conf.set(k, v)
    # a stream reads folders; as a pattern, a path may also name one file
    new = content(session.readStream.option("maxFilesPerTrigger", files), f"{path[:-1]}[{path[-1]}]")
    rows = new.select("doc_id", sha256(F.col("text")).alias("sha256"), "file", "row")
    _drain(rows.writeStream.format("parquet").option("path", f"{folder}/index")
           .option("checkpointLocation", f"{folder}/index_checkpoint"))
    if not path_exists(spark, f"{folder}/index/_spark_metadata"):
        return
    entries = (session.readStream.schema(INDEX).option("maxFilesPerTrigger", files).parquet(f"{folder}/index")
               .groupBy(key(width)).agg(F.count("*").alias("size"), F.max(F.struct("doc_id", "file", "row")).alias("keep")))

    def touched(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/entries/batch={number}")

    _drain(entries.writeStream.outputMode("update").foreachBatch(touched)
           .option("checkpointLocation", f"{folder}/state"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    if not path_exists(spark, f"{folder}/index/_spark_metadata"):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The current entry of every digest: digest, size, keep."""
    if not path_exists(spark, f"{folder}/entries"):
        return spark.createDataFrame([], ENTRY)
    written = spark.read.schema(ENTRY).parquet(f"{folder}/entries").select("digest", "size", "keep")
    return written.groupBy("digest").agg(F.max(F.struct("size", "keep")).alias("x")).select("digest", "x.size", "x.keep")


def with_hits(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows whose digest may have more than one row: a bounded bit map is broadcast (at most BITS bits)."""
    slot = lambda: F.pmod(F.xxhash64("digest"), F.lit(BITS)) + 1
    maps = (groups.filter(F.col("size") > 1).groupBy(F.bitmap_bucket_number(slot()).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot())).alias("bits")))
    at = F.bitmap_bit_position(slot())
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("long")
    found = rows.withColumns({"bucket": F.bitmap_bucket_number(slot()), "at": at}).join(F.broadcast(maps), "bucket")
    return found.filter(F.getbit(byte, F.col("at").cast("int") % 8) == 1).drop("bucket", "at", "bits")


def compare(spark: SparkSession, path: str, groups: DataFrame, width: int = WIDTH) -> DataFrame:
    """digest of each row whose text is not the text at the entry's locator."""
    rows = content(spark.read, path).withColumn("sha256", sha256(F.col("text")))
    hits = with_hits(rows.select("text", "file", "row", key(width)), groups)
    at = groups.filter(F.col("size") > 1).select("digest", F.col("keep.file").alias("file"), F.col("keep.row").alias("row"))
    keepers = hits.join(at, ["digest", "file", "row"]).select("digest", F.col("text").alias("kept_text"))
    return (hits.select("digest", "text").join(keepers, "digest")
            .filter(F.col("text") != F.col("kept_text")).select("digest"))


def resolve(spark: SparkSession, path: str, odd: DataFrame, width: int = WIDTH) -> DataFrame:
    """file, row, size, keep of the rows under the digests ``odd``: groups of the texts themselves."""
    rows = content(spark.read, path).withColumn("sha256", sha256(F.col("text"))).withColumn("digest", key(width))
    rows = rows.join(odd, "digest", "left_semi").select("text", F.struct("doc_id", "file", "row").alias("me"))
    groups = rows.groupBy("text").agg(F.count("*").alias("size"), F.max("me").alias("keep"))
    return rows.join(groups, "text").select("me.file", "me.row", "size", "keep")


def deduplicate(spark: SparkSession, path: str, folder: str | None = None, width: int = WIDTH, files: int = FILES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row taken in under ``folder`` so far.

    ``path`` holds all files taken in so far and the new ones; ``width`` must stay the same over one folder."""
    folder = folder or fresh_dir(spark, "exact_dedup")
    ingest(spark, path, folder, width, files)
    groups = cut(entries(spark, folder), "exact_groups")
    # written before it is made distinct: an aggregation on the join's key would keep AQE from splitting a large group
    odd = cut(compare(spark, path, groups, width), "exact_odd").distinct()
    rows, columns = index(spark, folder).withColumn("digest", key(width)), ("doc_id", "sha256", "file", "row", "size", "keep")
    out = rows.join(groups, "digest")
    if not odd.isEmpty():               # unlike texts under one digest: their groups are those of the texts
        own = rows.join(odd, "digest", "left_semi").join(resolve(spark, path, odd, width), ["file", "row"])
        out = out.join(odd, "digest", "left_anti").select(*columns).unionByName(own.select(*columns))
    kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"),
                      F.lower(F.hex("sha256")).alias("text_sha256"))

"""Helpers shared by the operators: input columns, written intermediates, id ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloss.session import fresh_dir

MIN_LONG = -(2**63)


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
         "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers some megabytes at a time, so that long texts do not pile up there."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


def texts(docs: DataFrame) -> DataFrame:
    """The two columns every operator reads; a null text is the empty text.
    Selecting them first keeps other columns, whatever their names, out of the way."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, kind: str, partition: str | None = None, compression: str | None = None) -> DataFrame:
    """Write to the shared folder (in folders by ``partition``, if given) and read back: later
    jobs start from the files, which survive the loss of any executor."""
    spark = df.sparkSession
    path = fresh_dir(spark, kind)
    df.write.parquet(path, partitionBy=partition, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_bounds(df: DataFrame, parts: int, col: str = "doc_id") -> list[int]:
    """At most ``parts - 1`` ascending cut points that split ``col`` into ranges of
    about equal row counts (one column-pruned scan; the driver gets the cut points only)."""
    probs = [i / parts for i in range(1, parts)]
    found = df.filter(F.col(col).isNotNull()).approxQuantile(col, probs, 0.5 / parts) if probs else []
    return sorted({int(x) for x in found})


def with_part(df: DataFrame, bounds: list[int], col: str = "doc_id", out: str = "part") -> DataFrame:
    """``out``: index of the id range, ascending with ``col``; null ids come before all others.
    The cut points are fixed numbers, so a task that runs again deals its rows out alike."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(dtype=np.int64), side="left").astype(np.int32))

    return df.withColumn(out, part_of(F.coalesce(F.col(col), F.lit(MIN_LONG))))


def nested(df: DataFrame) -> DataFrame:
    """All columns in one struct column ``row``, so that no name of theirs can clash with one added."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def learn_row(doc_id: str, mod: int, held: int):
    """Boolean column: the row is held out when crc32 of its id as text, mod ``mod``, is ``held``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == held


SAMPLE_ROWS = 2500          # labelled documents of each class that a classifier may learn from
SAMPLE_BYTES = 48 << 20     # and the most bytes of their texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int,
                    rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray, list[int]]:
    """Texts, their 0/1 labels and the counts of all learnable rows by label.

    A bounded sample: about ``rows`` documents of each class, taken by a hash of the id, and no
    more than ``size`` bytes in all; held-out rows never enter. The driver first gets ids, digests and lengths (one row
    an id, however many rows share it), and only then the texts that fit. A document labelled twice counts
    with its larger label; of several texts under one id the one with the smallest digest counts; rows with a null id or
    a label other than 0 and 1 are ignored.
    """
    spark = docs.sparkSession
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
           .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~learn_row("doc_id", mod, held))
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    counts = [counts.get(0, 0), counts.get(1, 0)]
    scale = 1 << 20
    share = [min(scale, int(scale * rows / max(1, c)) + 1) for c in counts]
    picked = lab.withColumn("h", F.xxhash64("doc_id")).filter(
        F.pmod(F.col("h"), F.lit(scale)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    # one text an id (the one with the smallest digest), and no text before it is known which ones fit
    held = texts(docs).join(F.broadcast(picked), "doc_id")
    one = F.min(F.struct(F.md5("text").alias("digest"), F.octet_length("text").alias("bytes"))).alias("x")
    found = (held.groupBy("h", "doc_id", "y").agg(one).select("h", "doc_id", "y", "x.*").collect() if sum(counts) else [])
    chosen, used = {}, 0
    for r in sorted(found, key=lambda r: (r["h"], r["doc_id"])):
        if used + r["bytes"] <= size:
            used += r["bytes"]
            chosen[r["doc_id"]] = r
    if not chosen:
        return [], np.zeros(0, dtype=np.int64), counts
    want = spark.createDataFrame([(d, r["digest"]) for d, r in chosen.items()], "doc_id long, digest string")
    rows_of = (texts(docs).withColumn("digest", F.md5("text")).join(F.broadcast(want), ["doc_id", "digest"])
               .groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    text_of = {r["doc_id"]: r["text"] for r in rows_of}
    ids = [d for d in chosen if d in text_of]
    return [text_of[d] for d in ids], np.array([chosen[d]["y"] for d in ids], dtype=np.int64), counts


def slices(sizes, limit: int):
    """(lo, hi) index ranges whose sizes add up to at most ``limit``; a larger single one stands alone."""
    lo = used = 0
    for i, n in enumerate(sizes):
        if i > lo and used + n > limit:
            yield lo, i
            lo, used = i, 0
        used += n
    if lo < len(sizes):
        yield lo, len(sizes)

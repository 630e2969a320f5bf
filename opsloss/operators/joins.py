"""Joins with dimensions (D1-D6) and the size-checked broadcast.

Dimensions are small by nature, but "small" is checked, not assumed:
``sized_broadcast`` adds up the bytes of everything the side reads, as the
plan's statistics tell them, and only then hints a broadcast. No job runs and
nothing is cached while a plan is built, so a dimension that another writer
changes is read anew by the next query. Beyond the bound the side is returned
unhinted and Spark plans a shuffle join, which AQE may still turn into a
broadcast from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_dir

DEFAULT_MAX_BROADCAST_BYTES = 32 << 20


def source_bytes(df: DataFrame) -> int:
    """Bytes of the files and local rows that ``df`` reads (plan statistics, no job)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))


def sized_broadcast(df: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its sources hold at most ``max_bytes``, else leave it to a shuffle join.

    For sides that have no more rows than their sources: versions reduced to
    the latest, distinct keys, a dimension joined to another by its unique id.
    """
    return F.broadcast(df) if source_bytes(df) <= max_bytes else df


def norms_with_rates(norms: DataFrame, rates: DataFrame, max_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """Norms ⋈ rates on ``role_id = tariff_id`` (inner).

    ``norms`` carries ``operation_name, norm_seconds, role_id``; ``rates``
    carries ``tariff_id, role_name, hourly_rate`` (staged names, B3/B4).
    """
    r = sized_broadcast(rates.select("tariff_id", "role_name", "hourly_rate"), max_bytes)
    return norms.join(r, norms["role_id"] == r["tariff_id"], "inner").select(
        "operation_name", "norm_seconds", "role_id", "role_name", "hourly_rate"
    )


def accept_with_parent(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> tuple[DataFrame, DataFrame]:
    """Split child rows into (accepted, rejected) by parent existence.

    Left-semi / left-anti joins: each child row is emitted at most once, no
    matter how many children one parent has. The parent key set is a
    dimension, broadcast after its size check, so a parent referenced by a
    third of all children causes no skewed join partition; beyond the bound
    the shuffle join relies on AQE's skew-join splitting.
    """
    p = sized_broadcast(parent.select(F.col(pk).alias("_pk")).distinct())
    cond = F.col(fk) == F.col("_pk")
    return child.join(p, cond, "left_semi"), child.join(p, cond, "left_anti")


def children_per_parent(parent: DataFrame, child: DataFrame, pk: str, fk: str, value: str) -> DataFrame:
    """Role → its norms, as per-parent aggregates.

    The reference navigates to a Python list of child objects. Lists of an
    unbounded group are not built here; the navigation is the join (D1) and
    per parent we keep count and value range, computed with partial
    aggregation before the shuffle.
    """
    agg = child.groupBy(F.col(fk).alias(pk)).agg(
        F.count(F.lit(1)).alias("child_count"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )
    return parent.join(agg, pk, "left").select(
        *parent.columns,
        F.coalesce(F.col("child_count"), F.lit(0).cast("bigint")).alias("child_count"),
        "min_value", "max_value",
    )


def new_rows_only(incoming: DataFrame, existing: DataFrame, unique_col: str, order_col: str | None = None) -> DataFrame:
    """A5: keep incoming rows whose unique column is not present yet.

    Duplicates inside the batch keep one row per value (the smallest
    ``order_col``, i.e. the first in the batch), like a unique constraint
    rejecting the later inserts.
    """
    order_col = order_col or unique_col
    fresh = incoming.join(sized_broadcast(existing.select(unique_col).distinct()), unique_col, "left_anti")
    firsts = fresh.groupBy(unique_col).agg(F.min_by(F.struct(*fresh.columns), F.col(order_col)).alias("_r"))
    return firsts.select(*[F.col(f"_r.{c}").alias(c) for c in fresh.columns])


def assign_ids(new_rows: DataFrame, existing: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """Dense ids for created dimension rows, after the largest existing id, in ``order_col`` order.

    One way at every size: the rows are dealt over ranges of ``order_col``
    and written to the shared folder; a row's id is the number of rows in the
    ranges before its own plus its place within it. Only the per-range counts
    (one row for each task) are summed up in a single task.
    """
    spark = new_rows.sparkSession
    order = order_col or new_rows.columns[0]
    path = fresh_dir(spark, "new_rows")
    new_rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order, *[c for c in new_rows.columns if c != order]))
    top = existing.agg(F.max(id_col)).first()[0]          # one scalar
    base = F.lit(int(top) if top is not None else 0).cast("bigint")
    return rows.withColumn("_place", place).join(offsets, "_range").select(
        (base + F.col("_before") + F.col("_place")).cast("bigint").alias(id_col), *new_rows.columns)

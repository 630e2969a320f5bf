"""Readers of the provided Parquet tables.

Column pruning and filter pushdown are left to Catalyst: callers select and
filter on the returned DataFrame and the Parquet scan reads only what the
plan needs (``ReadSchema`` / ``PushedFilters`` in ``explain``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))

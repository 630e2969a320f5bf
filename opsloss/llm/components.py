"""Connected components of a link table, as Spark joins and aggregates.

Alternating large-star and small-star steps: every node is re-linked to the smallest node it
knows of, until the links form stars. Each step shuffles the link table only, the number of
steps grows with the logarithm of the longest chain, and every round is written to the shared
folder. The smallest neighbour is an aggregate (combined before the shuffle), never a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloss.llm.common import cut


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node it is linked
    with, directly or through others. Self-links and repeated links are harmless."""
    def shape(df):
        return df.filter("a > b").distinct()

    edges = cut(shape(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = shape(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(shape(small), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

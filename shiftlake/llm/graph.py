"""Connected components of a link table: distributed union-find by DataFrame joins only.

Alternates two steps until nothing changes. Large star: every node points
its larger neighbours at its smallest one. Small star: every node points its
smaller neighbours, and itself, at the smallest. Each round at least halves
the depth of the trees in practice, so rounds grow with the logarithm of the
longest chain. Every round is written to the shared folder, where it takes the
place of the last one; only a count and a checksum reach the driver. Hubs are plain join keys, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlake.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component.

    ``links``: two long columns a, b. Null ends and self links are passed
    over; repeated links do no harm; no links give an empty table.
    """
    pair = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNotNull().alias("x"),
                        F.col("b").isNotNull().alias("y"))
    edges = stored(pair.where("x and y and a <> b").select("a", "b").distinct(), "links")
    seen = _digest(edges)
    while seen[0]:
        before, edges = edges, stored(_small_star(_large_star(edges)), "links")
        discard(before)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return (both.join(least, F.col("a") == F.col("c")).where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).where("b <> m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))).distinct()

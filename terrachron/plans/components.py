"""Connected components by alternating large-star and small-star steps.

Edges and labels stay in DataFrames. An edge (a, b) has a > b throughout. Each step is one
partial aggregation (the smallest smaller neighbour of a node) and one join, so a node with very many edges is
pre-aggregated before the shuffle and its join rows can be split by AQE; no
neighbour list is ever collected. The number of steps grows with the logarithm of
the longest path. A round of two steps reads its edges four times, so its plan stays small
in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrachron.plans.tables import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to its smallest neighbour, or to itself if it has no smaller one."""
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    both = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return edges.join(least, "a").select(F.explode(both).alias("e")).select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, tag: str = "components", most: int = 60) -> DataFrame:
    """``edges`` (a, b: comparable ids, not null) -> (node, label): the smallest id that each node can reach.

    Loops and repeated edges are allowed. Nodes without an edge to another node
    have no row: their label is their own id.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    seen = None
    for _ in range(most):
        nxt = written(_small_star(_large_star(now)), tag)
        drop(now)
        now = nxt
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node").union(now.select("b", "b").distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most} steps")

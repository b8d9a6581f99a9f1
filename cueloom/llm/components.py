"""Connected components as Spark joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or smaller and own) neighbours of every node on its smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if large:
        hung = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
    return hung.filter("u <> v").distinct()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; a component is named by its smallest node.

    Each step is two joins and is written to the shared folder, so lineage stays short. Nodes without an edge
    do not appear. The number of steps grows with the logarithm of a component's width; ``limit`` is a guard
    that raises, it never cuts short.
    """
    now = freeze(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = None
    for _ in range(limit):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        seen = mark
        now = freeze(_star(freeze(_star(now, large=True)), large=False))
    raise RuntimeError(f"components did not settle in {limit} steps")

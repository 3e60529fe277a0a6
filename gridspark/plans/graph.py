"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.lineage import cut, forget


def _toward_min(pairs: DataFrame) -> DataFrame:
    """Each node u and its neighbour v, with m, the smallest of u and all its neighbours.

    Only a partially aggregated minimum and an equi-join are used, so a hub of any size is dealt out over tasks.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("lowest"))
    return pairs.join(low, "u").select("u", "v", F.least("u", "lowest").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    star = _toward_min(down)
    return star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph ``edges(u, v)`` of comparable ids.

    Returns ``(node, component)`` for each node that has an edge to another node; the component is its smallest id.
    Rounds are O(log n) for long chains. Each round is checkpointed; only three numbers reach the driver.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("v")).first())
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = mark
        old, now = now, cut(_small_star(_large_star(now)).where("u != v").distinct())
        forget(old)
    raise RuntimeError("components did not converge")

"""Connected components by alternating star contraction, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) pairs of longs -> (node, component): each linked node with the smallest node it can reach.

    Nodes without a pair do not appear. Large and small stars alternate; a hub's neighbours are never
    gathered, only their minimum is, and every round ends in a written table. Nulls and self-links are
    ignored, repeated pairs count once; an empty table gives an empty one.
    """
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    edges = stash(pairs.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        edges = stash(_small_star(_large_star(edges).distinct()).filter("u > v").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))

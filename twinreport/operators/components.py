"""Connected components of links by alternating large and small stars; nothing is gathered in one place, hubs are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed, spread_join


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges (a, b), a > b, n of them. Large: every larger neighbour of a node joins its least one; small: every smaller one does."""
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("__m"))
    moved = near.filter("b > a") if large else near
    out = spread_join(moved, least.select("a", "m"), ["a"], counts=least.select("a", "__m"), rows=n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b) but the roots.

    Rounds go on until no link moves; their number grows with the logarithm of the nodes.
    """
    edges = checkpointed(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or now["n"] == 0:
            break
        before = now
        edges = checkpointed(_stars(checkpointed(_stars(edges, True, now["n"])), False, now["n"]))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

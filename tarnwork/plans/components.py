"""Connected components by alternating large-star and small-star steps.

Every step replaces the edges of a node by edges to its smallest neighbour, so the number of edges never grows
and no node's neighbours are gathered in one place: each step is a min() per node and a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # neighbours above the node move to its smallest neighbour
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge: columns ``node`` and ``component``, the smallest node reachable.

    Edges are undirected; loops, repeats and edges with a null end are ignored. Nodes are long integers.
    """
    now = written(
        edges.where(f"{left} is not null and {right} is not null and {left} <> {right}")
        .select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        now = written(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())

"""Connected components by alternating large-star and small-star steps, all distributed.

Every step groups the edges of a node, takes the smallest neighbour (pre-aggregated), and joins it
back, so a node with a huge neighbourhood is never gathered in one place. Each round is written to the
shared folder, which ends its lineage. The number of rounds grows with the logarithm of a component's size; after ``max_rounds`` of them
an error is raised, so no unfinished result is returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v); large: neighbours above u; small: neighbours not above u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v); component is its smallest node."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # settled when every node has one neighbour below it, and that one has none
        below = now.groupBy("u").agg(F.count("*").alias("n"))
        open_ = below.where("n > 1").select("u").limit(1).unionByName(now.select(F.col("v").alias("u")).join(below, "u", "left_semi").limit(1))
        if open_.isEmpty():
            break
        after = materialise(_star(_star(now, True), False), "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.scratch = now.scratch
    return out

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.plans.shared import discard, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of ``edges(a, b)``; a component is named by its least node.

    Each round points every node nearer to its component's least one and is written to
    the shared folder, after which the round before it is removed; rounds grow with the
    logarithm of the longest path, and end when every node points to one that points
    nowhere. Nodes without an edge do not appear.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct())
    for _ in range(max_rounds):
        ends = now.select("x", F.lit(1).alias("out"), F.lit(0).alias("into")).union(now.select("y", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
        if not ends.where("out > 1 or (out = 1 and into = 1)").limit(1).count():
            break
        both = now.union(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        near = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(near, "x").where("y <> m").select(F.greatest("y", "m").alias("x"), F.least("y", "m").alias("y"))
        before, now = now, stored(small.union(near.select("x", F.col("m").alias("y"))).distinct())
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("x").alias("node"), F.col("y").alias("component")).union(now.select("y", "y").distinct())

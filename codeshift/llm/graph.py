"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., 2014).  Nodes are 64-bit integers.  Every
round is written to the shared folder, so the plan stays short and a lost
executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``edges(a, b)``."""
    e = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "edges")
    state = None
    while True:
        # Large star: every larger neighbour is linked to the smallest of the neighbourhood.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        up = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = up.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, "edges")
        # Small star: every smaller neighbour, and the node, is linked to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        e = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

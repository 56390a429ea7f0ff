"""Plans that repeat until nothing changes: connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lantern.session import released, written

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(a, b) pairs of ids -> (id, component): each id of an edge and the smallest id it can
    reach. Each round is two aggregations for minima and two joins; a vertex's neighbours are
    never gathered. Rounds grow with the logarithm of the longest chain; tables of stars take
    two. What a round makes is written in the shared folder, and the round before it deleted."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
    e = written(e, "edges")  # repeated ones go in the first round
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()
        new = written(small, "edges")
        released(e, large)
        e = new
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            # Every edge now ends at its component's smallest id.
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")

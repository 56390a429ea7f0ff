"""Edge counts and degrees of a stream of messages (an addition: the batch forms are in
operators.mail and operators.degrees)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def edge_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, src, dst, n) of a stream (ts, src, dst): counts by tumbling window; rows later
    than `late` are dropped by the watermark."""
    e = events.withWatermark("ts", late).groupBy(F.window("ts", window), "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.col("window.start").alias("start"), "src", "dst", "n")


def degrees(events: DataFrame) -> DataFrame:
    """(id, n_out, n_in): messages sent and received so far; an update-mode stream."""
    ends = events.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.select("x.*").groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))

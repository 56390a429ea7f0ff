"""Degrees, branch factors and thresholds of nodes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lantern.graph import Graph

LEAST_THETA = 1e-6


def degrees(g: Graph) -> DataFrame:
    """id, n_out, n_in (distinct neighbours), w_out, w_in (summed weights); 0 where none."""
    one = F.when(F.col("weight") != 0, 1)
    ends = g.edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), one.alias("o"), F.lit(None).cast("int").alias("i"), F.col("weight").alias("wo"), F.lit(0.0).alias("wi")),
        F.struct(F.col("dst").alias("id"), F.lit(None).cast("int").alias("o"), one.alias("i"), F.lit(0.0).alias("wo"), F.col("weight").alias("wi")),
    )).alias("x")).select("x.*")
    # Nodes come in as rows without edges: one aggregation, no join.
    ends = ends.unionByName(g.nodes.select("id"), allowMissingColumns=True)
    return ends.groupBy("id").agg(
        F.count("o").alias("n_out"), F.count("i").alias("n_in"),
        F.coalesce(F.sum("wo"), F.lit(0.0)).alias("w_out"), F.coalesce(F.sum("wi"), F.lit(0.0)).alias("w_in"),
    )


def branch_factor(g: Graph) -> DataFrame:
    """One row: nodes, senders (nodes with an out-edge), the mean out-degree of all and of senders."""
    return degrees(g).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n_out") > 0).alias("senders"),
        F.coalesce(F.avg("n_out"), F.lit(0.0)).alias("mean"), F.coalesce(F.avg(F.when(F.col("n_out") > 0, F.col("n_out"))), F.lit(0.0)).alias("sender_mean"),
    )


def betas(g: Graph) -> DataFrame:
    """id, n_out, beta: the senders' mean out-degree, the node left out."""
    d = degrees(g)
    m = F.col("senders")
    beta = (m * F.col("sender_mean") - F.col("n_out")) / F.greatest(m - (F.col("n_out") > 0).cast("int"), F.lit(1))
    return d.join(F.broadcast(branch_factor(g))).select("id", "n_out", beta.alias("beta"))  # one row


def thetas(g: Graph, radius: int) -> DataFrame:
    """id, theta: what an ideal star around the node leaves at its rim after `radius`."""
    r = F.lit(float(radius))
    b = betas(g)
    if radius == 0:
        return b.select("id", F.lit(LEAST_THETA).alias("theta"))
    star = F.least(-r + math.log(radius) - F.ln("n_out"), -1.0 - F.ln("n_out") - (r - 1) * F.ln("beta") - math.lgamma(radius + 1))
    usable = (F.col("beta") >= 1e-8) & (F.col("n_out") >= 1)
    return b.select("id", F.greatest(F.exp(F.when(usable, F.least(-r, star)).otherwise(-r)), F.lit(LEAST_THETA)).alias("theta"))


def flat_thetas(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    return g.nodes.join(F.broadcast(n)).select("id", (1e-4 / F.col("n")).alias("theta"))  # one row


def inverse(x: Column, power: float = 1.0) -> Column:
    """x ** -power, and 0 for 0."""
    return F.when(x > 0, F.pow(x, F.lit(-power))).otherwise(0.0)

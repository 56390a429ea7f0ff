"""Scores of nodes by what points to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lantern.graph import Graph
from lantern.session import released, written

#: Rounds in one plan, before the state is written.
FUSED = 5


def page_rank(g: Graph, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """(node, rank): where a walker along out-edges (in proportion to their weights) is found,
    who starts anew at any node with probability 1 - damping, and wherever no edge leads on.

    New starts are the same for all nodes, so they only scale the solution: rounds add up
    what walks from one start a node reach, and the ranks are divided by their sum in the end.
    Ends after `rounds`, or where the last round changed the sum by less than a share of tol
    (looked at every FUSED rounds). Edges of weight 0 or less lead nowhere."""
    e = g.edges.filter("weight > 0")
    out = e.groupBy("src").agg(F.sum("weight").alias("all"))
    steps = e.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all") * damping).alias("p"), F.lit(0.0).alias("start"))
    # A node's own row starts a walk and carries its last rank: a round reads the state once.
    own = g.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("p"), F.lit(1.0).alias("start"))
    steps = written(steps.unionByName(own), "steps")
    state = written(g.nodes.select(F.col("id").alias("node"), F.lit(1.0).alias("rank"), F.lit(1.0).alias("last")), "ranks")
    for k in range(1, rounds + 1):
        moved = state.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("rank") * F.col("p") + F.col("start")).alias("got"), F.when(F.col("start") > 0, F.col("rank")).alias("last"))
        state = moved.groupBy("node").agg(F.sum("got").alias("rank"), F.max("last").alias("last"))
        if k % FUSED == 0 or k == rounds:
            state = written(state, "ranks")
            change = state.agg(F.sum(F.abs(F.col("rank") - F.col("last"))), F.sum("rank")).first()
            if change[1] is None or change[0] < tol * change[1]:
                break
    released(steps)
    total = state.agg(F.sum("rank").alias("total"))
    return state.join(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))  # one row


def leverage(g: Graph) -> DataFrame:
    """(node, score): the length of a node's column of the adjacency matrix, 0 where nothing
    points to it."""
    into = g.edges.select(F.col("dst").alias("node"), (F.col("weight") * F.col("weight")).alias("q"))
    every = into.unionByName(g.nodes.select(F.col("id").alias("node"), F.lit(0.0).alias("q")))
    return every.groupBy("node").agg(F.sqrt(F.sum("q")).alias("score"))

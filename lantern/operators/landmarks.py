"""Degree-bucket features and embeddings by similarity to landmark nodes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lantern.graph import Graph
from lantern.operators.centrality import betweenness, closeness
from lantern.operators.degrees import degrees
from lantern.operators.paths import hops
from lantern.operators.ranks import leverage, page_rank
from lantern.session import written


#: Fixed value: weight of in-degree features beside those by out-degree.
IN_WEIGHT = 17.0


def degree_features(g: Graph, weighted: bool = False) -> DataFrame:
    """(node, degree, out, in): counts of edges, or their weights' sums."""
    c = "w" if weighted else "n"
    d = degrees(g)
    return d.select(F.col("id").alias("node"), (F.col(f"{c}_out") + F.col(f"{c}_in")).cast("double").alias("degree"), F.col(f"{c}_out").cast("double").alias("out"), F.col(f"{c}_in").cast("double").alias("in"))


def at_least_one(features: DataFrame, names: list[str]) -> DataFrame:
    """Features made fit for buckets of logarithms: shifted so that none is negative; where
    some is under 1, divided by the smallest that isn't 0 (and one added if the largest is 1
    then), zeros made 1."""
    def bounds(df):
        return df.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in names for n, f in (("lo", F.min), ("hi", F.max), ("least", lambda x: F.min(F.when(x != 0, x))))])
    df = features
    low = df.agg(*[F.min(c).alias(f"min_{c}") for c in names])
    df = df.join(F.broadcast(low)).select("node", *[(F.col(c) - F.least(F.col(f"min_{c}"), F.lit(0.0))).alias(c) for c in names])  # one row
    df = df.join(F.broadcast(bounds(df)))  # one row
    def scaled(c):
        x = F.col(c) / F.col(f"least_{c}") + F.when(F.col(f"hi_{c}") == F.col(f"least_{c}"), 1.0).otherwise(0.0)
        return F.when(F.col(f"lo_{c}") >= 1, F.col(c)).otherwise(F.when((F.col(c) == 0) & (F.col(f"hi_{c}") != F.col(f"least_{c}")) | F.col(f"least_{c}").isNull(), 1.0).otherwise(x)).alias(c)
    return df.select("node", *map(scaled, names))


def bucket_features(g: Graph, depth: int = 2, alpha: float = 0.1, selected: DataFrame | None = None) -> DataFrame:
    """(node, bucket, value): for the nodes k hops away (0 to depth), alpha^k for each in the
    bucket floor(log2(degree)) of its out-degree; nodes of degree 0 count nowhere. selected
    (id): the nodes wanted."""
    d = degrees(g).select(F.col("id").alias("other"), F.col("n_out")).filter("n_out > 0")
    near = hops(g, g.nodes if selected is None else selected.select("id"), depth).select(F.col("source").alias("node"), F.col("node").alias("other"), "hops")
    at = near.join(d, "other").select("node", F.floor(F.log2("n_out")).cast("int").alias("bucket"), F.pow(F.lit(alpha), "hops").alias("w"))
    return at.groupBy("node", "bucket").agg(F.sum("w").alias("value"))


def directed_features(g: Graph, depth: int = 2, alpha: float = 0.1, directed: bool = True, selected: DataFrame | None = None) -> DataFrame:
    """(node, bucket, value): bucket features by out-edges, and behind them (bucket - 1000) those
    of the reversed graph times IN_WEIGHT; undirected graphs have theirs twice."""
    out = written(bucket_features(g, depth, alpha, selected), "buckets")
    back = bucket_features(g.reversed(), depth, alpha, selected).withColumn("value", F.col("value") * IN_WEIGHT) if directed else out
    return out.unionByName(back.withColumn("bucket", F.col("bucket") - 1000))


def embed(g: Graph, n: int | None = None, depth: int = 2, alpha: float = 0.1, gamma: float = 1.0, directed: bool = True, how: str = "degree", selected: DataFrame | None = None) -> DataFrame:
    """(node, features): landmark embedding with n landmarks (by default 10 log2 of the number
    of nodes) of a graph, by features of both directions; of the nodes selected (id) alone."""
    size = g.nodes.count() if selected is None else selected.count()
    n = min(n or landmark_count(size), size)
    f = written(directed_features(g, depth, alpha, directed, selected), "features")
    marks = written(landmarks(g, n, how, among=selected), "landmarks")
    # A node without features is as near to any other as one whose features are all 0.
    every = f.unionByName((g.nodes if selected is None else selected).select(F.col("id").alias("node"), F.lit(0).alias("bucket"), F.lit(0.0).alias("value")))
    return landmark_embedding(written(similarities(every.groupBy("node", "bucket").agg(F.sum("value").alias("value")), marks, gamma), "similar"))


#: Scores of nodes that landmarks can be taken in proportion to.
SCORES = {"leverage": leverage, "rank": page_rank, "betweenness": betweenness, "closeness": closeness}


def landmarks(g: Graph, n: int, how: str = "degree", seed: int = 0, among: DataFrame | None = None) -> DataFrame:
    """(node): n nodes (of those in among (id), if given), those of largest degree (ties by id),
    a random sample, or one in proportion to the degree, or to the leverage, rank, betweenness
    or closeness of nodes; "top NAME": those of the largest such score. Scores are of the whole
    graph."""
    best, _, name = how.rpartition(" ")
    if name in SCORES:
        d = SCORES[name](g)
        d = d.withColumnRenamed(next(c for c in d.columns if c != "node"), "d")
        how = "degree" if best == "top" else "proportional"
    else:
        d = degrees(g).select(F.col("id").alias("node"), (F.col("n_out") + F.col("n_in")).alias("d"))
    if among is not None:
        d = d.join(among.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    u = (F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    order = {"degree": [F.desc("d"), "node"], "random": [u, "node"], "proportional": [-F.ln(u) / F.greatest("d", F.lit(1e-9)), "node"]}[how]
    return d.orderBy(*order).limit(n).select("node")


def wide(features: DataFrame) -> DataFrame:
    """(node, f map<int, double>) of (node, bucket, value); a map is as long as there are
    buckets, the logarithm of the largest degree."""
    return features.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("f"))


def similarities(features: DataFrame, marks: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(node, landmark, similarity): exp(-gamma * distance). Landmarks are a set of stated
    size, so each task has all of them."""
    w = written(wide(features), "wide")
    m = w.join(marks, "node", "left_semi").select(F.col("node").alias("landmark"), F.col("f").alias("l"))
    keys = F.array_union(F.map_keys("f"), F.map_keys("l"))
    d = lambda k: F.coalesce(F.col("f")[k], F.lit(0.0)) - F.coalesce(F.col("l")[k], F.lit(0.0))
    square = F.aggregate(keys, F.lit(0.0), lambda s, k: s + d(k) * d(k))
    return w.join(F.broadcast(m)).select("node", "landmark", F.exp(-gamma * F.sqrt(square)).alias("similarity"))


def landmark_embedding(c: DataFrame) -> DataFrame:
    """(node, features array<double>) from similarities: with W the landmarks' own, rows of
    C U sqrt(S) of the pseudo-inverse of W, each scaled to length 1. Only W, landmarks by
    landmarks, is on the driver."""
    names = [r["landmark"] for r in c.select("landmark").distinct().orderBy("landmark").collect()]
    place = {x: i for i, x in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    marks = c.select(F.col("landmark").alias("node")).distinct()
    for r in c.join(marks, "node", "left_semi").collect():
        w[place[r["node"]], place[r["landmark"]]] = r["similarity"]
    u, s, _ = np.linalg.svd(np.linalg.pinv(w))
    m = u * np.sqrt(s)
    rows = c.sparkSession.createDataFrame([(x, m[i].tolist()) for x, i in place.items()], "landmark long, m array<double>")
    y = c.join(F.broadcast(rows), "landmark").select("node", F.posexplode("m").alias("col", "x"), "similarity")
    y = y.groupBy("node", "col").agg(F.sum(F.col("similarity") * F.col("x")).alias("y")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("col", "y"))).alias("y"))
    norm = F.sqrt(F.aggregate("y.y", F.lit(0.0), lambda t, x: t + x * x))
    return y.select("node", F.transform("y.y", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("features"))


def landmark_count(n: int, k: int = 10) -> int:
    return min(int(k * math.log2(max(n, 2))), n)

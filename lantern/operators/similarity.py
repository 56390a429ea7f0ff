"""Structural distances between nodes, rank correlation, and alignment of two graphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lantern.graph import Graph, before, in_order, reindex, relabel
from lantern.operators import report
from lantern.operators.neighbours import nearest  # noqa: F401  a structural distance like those here
from lantern.operators.paths import hops, weighted_distances
from lantern.session import written


def distance_profiles(g: Graph, weighted: bool = False) -> DataFrame:
    """(node, profile array<double>): reciprocal distances to all others, smallest first, in
    the in-direction and then in the out-direction; 0 for nodes out of reach."""
    d = weighted_distances(g, g.nodes).withColumnRenamed("distance", "d") if weighted else hops(g, g.nodes).withColumn("d", F.col("hops").cast("double"))
    d = d.filter("source <> node").select("source", "node", (1 / F.col("d")).alias("r"))
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    def side(end: str):
        per = d.groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_list("r")).alias("r"))
        all_ = g.nodes.join(per, "id", "left").join(F.broadcast(n))  # one row
        r = F.coalesce("r", F.array().cast("array<double>"))
        return all_.select("id", F.concat(F.array_repeat(F.lit(0.0), (F.col("n") - 1 - F.size(r)).cast("int")), r).alias(end))
    return side("node").join(side("source"), "id").select(F.col("id").alias("node"), F.concat("node", "source").alias("profile"))


def pair_distances(profiles: DataFrame, column: str = "profile") -> DataFrame:
    """(a, b, euclidean, cosine) of all pairs a < b: for graphs of stated, small size."""
    a, b = profiles.select(F.col("node").alias("a"), F.col(column).alias("x")), profiles.select(F.col("node").alias("b"), F.col(column).alias("y"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    gap = F.aggregate(F.zip_with("x", "y", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    cosine = 1 - dot("x", "y") / F.sqrt(dot("x", "x") * dot("y", "y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(gap).alias("euclidean"), cosine.alias("cosine"))


#: Blocks a side that kendall_tau() cuts each column into, at most, and rows of a block at least.
BLOCKS, BLOCK_ROWS = 1000, 4096


def agreement(x: np.ndarray, y: np.ndarray, k: np.ndarray) -> float:
    """Sum over pairs with x[i] < x[j] of k[i] * k[j] * sign(y[j] - y[i]). Two ranks of x part
    at their highest different bit; at each bit, the lower half of a group is counted below
    and above each y of the upper half."""
    x, y = (np.unique(z, return_inverse=True)[1].astype(np.int64) for z in (x, y))
    k = k.astype(float)
    n_y, total = int(y.max(initial=0)) + 1, 0.0
    order = np.argsort(y, kind="stable")
    x, y, k = x[order], y[order], k[order]
    for bit in range(int(x.max(initial=0)).bit_length()):
        group, low = x >> bit + 1, (x >> bit & 1) == 0
        key = group * n_y + y
        at = np.flatnonzero(low)
        at = at[np.argsort(key[at], kind="stable")]
        sums, keys = np.concatenate([[0.0], np.cumsum(k[at])]), key[at]
        find = lambda z, side: sums[np.searchsorted(keys, z, side)]  # noqa: E731, B023
        g, z = group[~low] * n_y, key[~low]
        below, above = find(z, "left") - find(g, "left"), find(g + n_y, "left") - find(z, "right")
        total += float((k[~low] * (below - above)).sum())
    return total


def kendall_tau(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row: tau-b of two columns, ties counted; null if one of them has one value only.
    Rows are first counted by (x, y). Both columns are cut into blocks by quantiles. Pairs in
    different blocks on both sides follow from the blocks' counts; those in one block of x, or
    in one of y and different ones of x, are counted in a task for each block, whose rows are
    a thousandth of all at most, or tie (a block of one value)."""
    numeric = pairs.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    c = written(numeric.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k")), "counts")
    blocks = max(1, min(BLOCKS, c.count() // BLOCK_ROWS))
    marks = [i / blocks for i in range(1, blocks)]
    cuts = c.approxQuantile(["x", "y"], marks, 0.2 / blocks) if marks else [[], []]

    def numbered(name: str, at: list[float]):
        # Block 2i + 1 is the value at[i] alone, 2i what lies between at[i - 1] and it.
        at = np.unique(np.array(at))

        @F.pandas_udf("int")
        def number(v: pd.Series) -> pd.Series:
            left, right = np.searchsorted(at, v, "left"), np.searchsorted(at, v, "right")
            return pd.Series(left + right)

        return number(F.col(name))

    c = written(c.withColumn("bx", numbered("x", cuts[0])).withColumn("by", numbered("y", cuts[1])), "blocks")
    cells = c.groupBy("bx", "by").agg(F.sum("k").alias("k")).toArrow()  # (2 * BLOCKS)^2 rows at most
    size = 2 * blocks + 1
    grid = np.zeros((size, size))
    grid[cells.column("bx").to_numpy(), cells.column("by").to_numpy()] = cells.column("k").to_numpy()
    # Rows before, then counts below less counts above.
    ahead = np.cumsum(grid, axis=0) - grid
    below = np.cumsum(ahead, axis=1) - ahead
    coarse = float((grid * (below - (ahead.sum(axis=1, keepdims=True) - below - ahead))).sum())

    def within(key, rows):
        return pd.DataFrame({"s": [agreement(rows["x"].to_numpy(), rows["y"].to_numpy(), rows["k"].to_numpy())]})

    def across(key, rows):
        return pd.DataFrame({"s": [agreement(rows["bx"].to_numpy(), rows["y"].to_numpy(), rows["k"].to_numpy())]})

    # A block of one value has no pair to count there.
    own = c.filter("bx % 2 = 0").groupBy("bx").applyInPandas(within, "s double")
    more = c.filter("by % 2 = 0").groupBy("by").applyInPandas(across, "s double")
    later = own.unionByName(more).agg((F.coalesce(F.sum("s"), F.lit(0.0)) + coarse).alias("s"))
    half = lambda col: F.sum(F.col(col) * (F.col(col) - 1) / 2)
    ties = lambda by: c.groupBy(by).agg(F.sum("k").alias("k")).agg(half("k").alias(f"t_{by}"))
    n = c.agg((F.sum("k") * (F.sum("k") - 1) / 2).alias("n"))
    all_ = later.join(ties("x")).join(ties("y")).join(n)  # one row each
    whole = (F.col("n") - F.col("t_x")) * (F.col("n") - F.col("t_y"))
    return all_.select(F.when(whole > 0, F.col("s") / F.sqrt(whole)).alias("tau"))


def top_k_accuracy(near: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    """One row: shares of queries whose match (query, node) is among their first k."""
    found = truth.join(near.select("query", "node", "rank"), ["query", "node"], "left")
    return found.agg(*[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"k_{k}") for k in ks])


def permuted(g: Graph, seed: int) -> tuple[Graph, DataFrame]:
    """The graph with its ids dealt anew, and the map (node, new)."""
    key = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id").alias("node"))
    m = reindex(g.nodes.select(key.alias("k")), "k").select("k.node", F.col("index").alias("new"))
    return Graph(relabel(g.edges, m.withColumnRenamed("new", "index"), "node"), m.select(F.col("new").alias("id"))), m


def drawn(g: Graph, n: int, want: int, seed: int) -> DataFrame:
    """(src, dst, draw): the first `want` new pairs src < dst of nodes 0 .. n-1 that draws by a
    hash of their number give, and these numbers; the same however rows are dealt."""
    spark = g.edges.sparkSession
    pair = lambda x, y: (F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
    old = written(g.edges.filter("src <> dst").select(*pair("src", "dst")).distinct(), "pairs")
    free = n * (n - 1) // 2 - old.filter((F.col("src") >= 0) & (F.col("dst") < n)).count()
    if want > free:
        raise ValueError(f"{want} new pairs are wanted and {free} are free")
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(2 * seed + i)), F.lit(n))
    found, first, size = None, 0, 2 * want + 16
    while True:
        draws = spark.range(first, first + size).select("id", u(0).alias("x"), u(1).alias("y")).filter("x <> y").select(*pair("x", "y"), F.col("id").alias("draw"))
        new = draws.join(old, ["src", "dst"], "left_anti")
        found = written((new if found is None else found.unionByName(new)).groupBy("src", "dst").agg(F.min("draw").alias("draw")), "noise")
        if found.count() >= want:
            break
        first, size = first + size, 2 * size
    placed = in_order(found, "draw")
    ahead = before(placed, F.count(F.lit(1)))  # a row per range
    return placed.join(F.broadcast(ahead), "_p").filter(F.col("before") + F.col("_i") < want).select("src", "dst", "draw")


def noise_edges(g: Graph, n: int, share: float, seed: int = 0) -> DataFrame:
    """(src, dst) with src < dst: share * edges new pairs that the graph has in neither
    direction, among nodes 0 .. n-1. ValueError if there aren't so many."""
    return drawn(g, n, int(share * g.edges.count()), seed).select("src", "dst")


def with_noise(g: Graph, n: int, share: float, seed: int = 0) -> tuple[Graph, float]:
    """g with noise edges, their weights drawn from the weights that g has, and the share of
    edges that were added."""
    u = F.pmod(F.xxhash64("draw", F.lit(2 * seed + 99)), F.lit(1 << 52)) / float(1 << 52)
    new = written(drawn(g, n, int(share * g.edges.count()), seed).withColumn("u", u), "noise")
    values = report.sample_distribution(report.cumulative_shares(g.edges, "weight"), "weight", new.select("draw", "u"))
    noise = new.join(values, "draw").select("src", "dst", F.col("value").alias("weight"))
    edges, added = g.edges.count(), new.count()
    return Graph(g.edges.unionByName(noise), g.nodes), added / max(1, edges)


def alignment_maps(n1: int, n2: int, g2_to_g1: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((g2_node, merged), (g1_node, g2_node)) of an alignment (g2_node, g1_node) of graphs of
    n2 and n1 nodes, the second's nodes behind the first's. ValueError if it isn't one-to-one
    from all of the second graph into the first."""
    s = g2_to_g1.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("g2_node").alias("a"), F.countDistinct("g1_node").alias("b"), F.count_if((F.col("g2_node") < 0) | (F.col("g2_node") >= n2) | (F.col("g1_node") < 0) | (F.col("g1_node") >= n1)).alias("out")).first()
    if (s["n"], s["a"], s["b"], s["out"]) != (n2, n2, n2, 0):
        raise ValueError("the alignment is not one-to-one on both graphs' nodes")
    merged = g2_to_g1.sparkSession.range(n2).select(F.col("id").alias("g2_node"), (F.col("id") + n1).alias("merged"))
    return merged, g2_to_g1.select("g1_node", "g2_node")


def split_embedding(embedding: DataFrame, n1: int) -> tuple[DataFrame, DataFrame]:
    """The rows of both graphs of a union, the second's nodes numbered from 0."""
    return embedding.filter(F.col("node") < n1), embedding.filter(F.col("node") >= n1).withColumn("node", F.col("node") - n1)


def heat_changes(a: DataFrame, b: DataFrame, g: Graph) -> DataFrame:
    """(source, tau, ks, statistic, area) between two heats (source, node, tau, psi) on g's
    nodes, each source's values in order: the largest difference of values of one place, the
    two-sample Kolmogorov-Smirnov statistic, and the area between the curve of both (the mean
    of both values' trapezia). Values left out are 0."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    keys = a.select("source", "tau").unionByName(b.select("source", "tau")).distinct().join(F.broadcast(n))  # one row
    lists = lambda p, name: p.groupBy("source", "tau").agg(F.array_sort(F.collect_list("psi")).alias(name))
    x = keys.join(lists(a, "x"), ["source", "tau"], "left").join(lists(b, "y"), ["source", "tau"], "left")
    full = lambda c: F.array_sort(F.concat(F.array_repeat(F.lit(0.0), (F.col("n") - F.size(F.coalesce(c, F.array().cast("array<double>")))).cast("int")), F.coalesce(c, F.array().cast("array<double>"))))
    x = x.withColumn("x", full(F.col("x"))).withColumn("y", full(F.col("y")))

    @F.pandas_udf("struct<ks: double, statistic: double, area: double>")
    def distances(p: pd.Series, q: pd.Series) -> pd.DataFrame:
        out = []
        for u, v in zip(p, q):
            u, v = np.asarray(u), np.asarray(v)
            every = np.concatenate([u, v])
            steps = np.searchsorted(u, every, "right") / len(u) - np.searchsorted(v, every, "right") / len(v)
            middle = np.abs((v[1:] + v[:-1]) - (u[1:] + u[:-1])) / 2
            out.append((np.abs(u - v).max(), np.abs(steps).max(), float((middle * (np.diff(u) + np.diff(v)) / 2).sum())))
        return pd.DataFrame(out, columns=["ks", "statistic", "area"])

    return x.select("source", "tau", distances("x", "y").alias("d")).select("source", "tau", "d.*")

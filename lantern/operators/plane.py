"""A plane in which rows lie by their neighbours, and how far it can be trusted.

The fuzzy neighbour graph: a row's weight to each of its k nearest others falls from 1 at the
nearest one with a width of its own, chosen so that its weights add up to log2(k); both
directions' weights are joined as probabilities that either link holds.

The layout is found in rounds. In a round every link pulls its two ends together, every row is
pushed off a few others, and it moves by their balance, measured by the pull's own stiffness
(so that a step never overshoots what it pulls to, however many links a row has). Whom a row is
pushed off is a shift of the rows' numbers that changes with each round: all others are equally
likely, each row is asked for equally often, and no pairs are drawn up. Links are rows, so one
that many have as a neighbour is no group: joins on it can be split, sums are combined first.
Rounds cut lineage; reruns give the same plane up to rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.graph import Graph, reindex
from lantern.operators.degrees import degrees
from lantern.operators.density import outlier_scores
from lantern.operators.evaluate import principal, scaled
from lantern.operators.neighbours import PART_ROWS, nearest, rows_of
from lantern.session import released, written

#: A row's width is at least this part of the mean distance of its neighbours.
LEAST_WIDTH = 1e-3
#: Steps of the search for the width: enough for all bits of a double.
HALVINGS = 60
#: Half the side of the square the layout starts in; the largest push along an axis.
START, PUSH = 10.0, 4.0


def curve(least: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^(2b)), fitted by least squares to a curve that is 1 up to
    distance `least` and falls off exponentially with `spread` beyond."""
    d = np.linspace(0, 3 * spread, 301)[1:]
    want = np.where(d <= least, 1.0, np.exp(-(d - least) / spread))
    def residual(p):
        return 1 / (1 + np.exp(p[0]) * d ** (2 * p[1])) - want
    p, damping = np.array([0.0, 1.0]), 1e-2
    r = residual(p)
    for _ in range(200):
        y = r + want
        j = np.stack([-y * (1 - y), -y * (1 - y) * 2 * np.log(d)], axis=1)
        step = np.linalg.solve(j.T @ j + damping * np.eye(2), -j.T @ r)
        new = residual(p + step)
        if new @ new < r @ r:
            p, r, damping = p + step, new, damping / 3
            if np.abs(step).max() < 1e-12:
                break
        else:
            damping *= 3
    return float(np.exp(p[0])), float(p[1])


def width(beyond: Column) -> Column:
    """The width at which exp(-x / width), summed over the array of distances beyond the
    nearest, is log2 of their number. As exp(-x) >= 1 - x, a width of sum(x) / (k - log2 k) is
    enough, and the search halves what is between 0 and that."""
    k = F.size(beyond)
    goal = F.log2(k.cast("double"))
    most = F.aggregate(beyond, F.lit(0.0), lambda s, x: s + x) / (k - goal)
    def halved(s, _):
        middle = (s["low"] + s["high"]) / 2
        got = F.aggregate(beyond, F.lit(0.0), lambda t, x: t + F.exp(-x / middle))
        return F.struct(F.when(got < goal, middle).otherwise(s["low"]).alias("low"), F.when(got < goal, s["high"]).otherwise(middle).alias("high"))
    return F.when(most > 0, F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.lit(0.0).alias("low"), most.alias("high")), halved)["high"]).otherwise(0.0)


def fuzzy(rows: DataFrame, k: int = 15, pivots: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, other, weight), node < other: the fuzzy neighbour graph of (node, features), of
    the k nearest others (ties by node). Rows that are equal have weight 1."""
    near = nearest(rows, rows, k + 1, pivots, part_rows).filter("query <> node")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "node"))
    near = near.select(F.col("query").alias("node"), F.col("node").alias("other"), "distance", rank.alias("rank")).filter(F.col("rank") <= k)
    own = near.groupBy("node").agg(F.collect_list(F.struct("other", "distance")).alias("l"), F.coalesce(F.min(F.when(F.col("distance") > 0, F.col("distance"))), F.lit(0.0)).alias("first"), F.avg("distance").alias("mean"))
    own = own.withColumn("beyond", F.transform("l", lambda x: F.greatest(x["distance"] - F.col("first"), F.lit(0.0))))
    own = own.withColumn("width", F.greatest(width(F.col("beyond")), F.col("mean") * LEAST_WIDTH))
    weight = lambda x: F.when(x["distance"] <= F.col("first"), 1.0).otherwise(F.exp((F.col("first") - x["distance"]) / F.col("width")))
    links = own.select("node", F.explode(F.transform("l", lambda x: F.struct(x["other"].alias("other"), weight(x).alias("w")))).alias("x"))
    both = links.groupBy(F.least("node", "x.other").alias("node"), F.greatest("node", "x.other").alias("other"))
    # The probability that one of up to two links holds.
    return both.agg((F.sum("x.w") + F.max("x.w") * F.min("x.w") * F.when(F.count(F.lit(1)) > 1, -1.0).otherwise(0.0)).alias("weight"))


def started(rows: DataFrame) -> DataFrame:
    """(node, x, y): principal components in a square of START, rows set off from equal ones."""
    ids = rows.select("node")
    if rows.limit(2).count() < 2:
        return ids.select("node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    k = min(2, rows.select(F.size("features")).first()[0])
    p = written(principal(rows, k), "principal")
    most = p.agg(F.max(F.array_max(F.transform("features", F.abs))).alias("most"))
    def at(i):
        off = (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(1 << 20)) / (1 << 20) - 0.5) * (START * 1e-4)
        c = F.get("features", F.lit(i)) if i < k else F.lit(0.0)
        return F.when(F.col("most") > 0, c * START / F.col("most")).otherwise(0.0) + off
    return p.join(F.broadcast(most)).select("node", at(0).alias("x"), at(1).alias("y"))  # one row


def moved(state: DataFrame, links: DataFrame, n: int, rounds: int, negatives: int, a: float, b: float, seed: int) -> DataFrame:
    """state (at, node, x, y, round) a round later; links (a, b, weight) between places `at`.
    The round is a column, so that each one runs the same compiled code."""
    # Dealt out, not broadcast: in every round a broadcast would pass through the driver.
    state = state.hint("merge")
    here = state.select(F.col("at").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    pulls = links.join(here, "a").select("a", "b", "weight", "xa", "ya")
    shift = lambda t: F.pmod(F.xxhash64("round", F.lit(t), F.lit(seed)), F.lit(n - 1)) + 1
    others = F.explode(F.array(*[(F.col("at") + shift(t)) % n for t in range(negatives)]))
    pushes = state.select(F.col("at").alias("a"), others.alias("b"), F.lit(None).cast("double").alias("weight"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    pairs = pulls.unionByName(pushes).join(state.select(F.col("at").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb")), "b")
    dx, dy, w = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"), F.col("weight")
    pairs = pairs.select("a", "b", "weight", dx.alias("dx"), dy.alias("dy"), F.greatest(dx * dx + dy * dy, F.lit(1e-12)).alias("d2"))
    stiff = w * 2 * a * b * F.pow("d2", F.lit(b - 1)) / (1 + a * F.pow("d2", F.lit(b)))
    push = -2 * b / ((0.001 + F.col("d2")) * (1 + a * F.pow("d2", F.lit(b))))
    held = lambda c: F.greatest(F.least(c, F.lit(PUSH)), F.lit(-PUSH))
    pairs = pairs.select("a", "b", "weight", "dx", "dy", stiff.alias("c"), held(push * F.col("dx")).alias("px"), held(push * F.col("dy")).alias("py"))
    zero = F.lit(0.0)
    def end(at, sign):
        return F.struct(F.col(at).alias("at"), w.alias("w"), F.col("c").alias("c"), (sign * F.col("c") * F.col("dx")).alias("fx"), (sign * F.col("c") * F.col("dy")).alias("fy"), zero.alias("px"), zero.alias("py"))
    pushed = F.struct(F.col("a").alias("at"), zero.alias("w"), zero.alias("c"), zero.alias("fx"), zero.alias("fy"), "px", "py")
    ends = pairs.select(F.explode(F.when(w.isNull(), F.array(pushed)).otherwise(F.array(end("a", 1), end("b", -1)))).alias("e")).select("e.*")
    sums = ends.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("w", "c", "fx", "fy", "px", "py")])
    rate = 1 - F.col("round") / F.lit(float(rounds))
    # Of each link a row holds, half its weight is met by pushes of `negatives` others.
    step = lambda f, p: F.when(F.col("c") > 0, rate * held((F.col(f) + F.col("w") * F.col(p) / 2) / F.col("c"))).otherwise(0.0)
    return state.join(sums, "at").select("at", "node", (F.col("x") + step("fx", "px")).alias("x"), (F.col("y") + step("fy", "py")).alias("y"), (F.col("round") + 1).alias("round"))


def plane(rows: DataFrame, k: int = 15, rounds: int = 60, negatives: int = 5, least: float = 0.1, seed: int = 0, pivots: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, x, y) of (node, features), node once each: rows near each other in their features
    lie near each other. One row lies at 0, 0; rows without a neighbour don't occur."""
    rows = written(rows.select(F.col("node").cast("long").alias("node"), F.col("features").cast("array<double>").alias("features")), "rows")
    index = reindex(rows, "node").withColumnRenamed("index", "at")
    state = written(started(rows).join(index, "node").select("at", "node", "x", "y", F.lit(0).alias("round")), "layout")
    n = state.count()
    if n > 1:
        index = state.select("node", "at")
        links = fuzzy(rows, k, pivots, part_rows).join(index, "node").withColumnRenamed("at", "a").drop("node")
        links = written(links.join(index.withColumnRenamed("node", "other"), "other").select("a", F.col("at").alias("b"), "weight"), "links")
        a, b = curve(least)
        for _ in range(rounds):
            new = written(moved(state, links, n, rounds, negatives, a, b, seed), "layout")
            released(state)
            state = new
        released(links)
    return state.select("node", "x", "y")


def overview(rows: DataFrame, g: Graph, k: int = 15, m: int = 15, rounds: int = 60) -> DataFrame:
    """(node, x, y, degree, outlier_score): what a picture of an embedding (node, features) of
    a graph shows, by its standardised features; degree counts edges of both directions."""
    z = written(scaled(rows), "scaled")
    d = degrees(g).select(F.col("id").alias("node"), (F.col("n_out") + F.col("n_in")).alias("degree"))
    score = outlier_scores(z, m).select("node", F.col("score").alias("outlier_score"))
    return plane(z, k, rounds).join(d, "node", "left").join(score, "node", "left").select("node", "x", "y", F.coalesce("degree", F.lit(0)).alias("degree"), "outlier_score")


def trustworthiness(rows: DataFrame, places: DataFrame, queries: DataFrame, k: int = 15, block: int = 1000) -> DataFrame:
    """(query, penalty, trust): of each of queries (node), how far down the list of its
    neighbours by features (node, features) its k nearest in places (node, features) stand:
    penalty sums rank - k of those beyond k, trust is 1 less its share of the most there can be.
    The mean of trust over all rows is the trustworthiness of the places. A row is compared
    with a block of queries at a time; ties by node."""
    n = rows.count()
    asked = queries.select("node").distinct()
    near = nearest(places.join(asked, "node"), places, k + 1).filter("query <> node")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "node"))
    near = written(near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "node"), "near")
    base = rows.select(F.col("node").cast("long").alias("node"), F.col("features").cast("array<double>").alias("features"))
    numbers = written(reindex(asked, "node"), "queries")
    count = numbers.count()
    out = None
    for first in range(0, count, block):
        ask = numbers.filter((F.col("index") >= first) & (F.col("index") < first + block)).select("node")
        own = sorted(base.join(F.broadcast(ask), "node").collect())  # a block of rows
        theirs = near.join(F.broadcast(ask.withColumnRenamed("node", "query")), "query").join(base, "node").groupBy("query").agg(F.sort_array(F.collect_list("node")).alias("n"), F.array_sort(F.collect_list(F.struct("node", "features"))).alias("l"))
        found = {r["query"]: (np.array(r["n"]), np.array([x["features"] for x in r["l"]])) for r in theirs.collect()}
        marks = [(r["node"], np.array(r["features"]), *found[r["node"]]) for r in own if r["node"] in found]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(len(m[2]), dtype=np.int64) for m in marks]
            for t in batches:
                ids, x = t.column("node").to_numpy(), rows_of(t.column("features"))
                if not len(ids):
                    continue
                for i, (q, f, other, theirs) in enumerate(marks):
                    # Differences, as of rows that are equal none is nearer.
                    d, mark = ((x - f) ** 2).sum(axis=1)[:, None], ((theirs - f) ** 2).sum(axis=1)
                    nearer = (d < mark) | (d == mark) & (ids[:, None] < other)
                    total[i] += (nearer & (ids != q)[:, None]).sum(axis=0)
            for m, c in zip(marks, total):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), m[0])), pa.array(m[2]), pa.array(c)], names=["query", "node", "before"])

        got = base.mapInArrow(run, "query long, node long, before long").groupBy("query", "node").agg((F.sum("before") + 1).alias("rank"))
        got = written(got.groupBy("query").agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0))).alias("penalty")), "trust")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query long, penalty long, trust double")
    # Ranks n - k to n - 1 are the worst that k neighbours can have.
    most = max(1.0, k * (2 * n - 3 * k - 1) / 2)
    return out.select("query", "penalty", (1 - F.col("penalty") / most).alias("trust"))

"""Distances from many sources at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lantern.graph import Graph
from lantern.operators.lanes import BITS, LANES, WORDS, any_of, bit, dealt, headed, heads, met, named, numbering, placed, ranges, set_bits, together
from lantern.session import released, written


def hops(g: Graph, sources: DataFrame, depth: int | None = None, most: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, hops) of the nodes within depth. most: nodes with that many out-edges
    or more are reached but not gone beyond, unless they are the source. targets (source,
    node): only these are returned, and a source is done when all of its are reached.

    Sources are bits: a node's row holds which of a block's sources have reached it, and which
    in the last level. In a level a row goes once to each range of ids that its edges lead to
    (lanes.met), a node's own along with them, and bits are united there; the state takes nodes
    x sources / 8 bytes, whatever the levels."""
    where = ranges(g.nodes.select("id").unionByName(sources.select("id")).distinct())
    lists = dealt(g.edges.select(F.col("src").alias("_s"), "dst"), where)  # each level reads it
    top = heads(lists, where)
    if most is not None:
        big = lists.groupBy("_s").agg(F.sum(F.size("to")).alias("k")).filter(F.col("k") >= most).select(F.col("_s").alias("node"))
    places = numbering(sources, BITS * WORDS)
    seen, new, zero = named("s", WORDS), named("n", WORDS), F.lit(0).cast("long")
    own = [bit(F.col("lane"), i) for i in range(WORDS)]
    state = places.select(F.col("source").alias("node"), "block", *[x.alias(c) for x, c in zip(own + own, seen + new)])
    state = placed(state.groupBy("node", "block").agg(*[F.bit_or(c).alias(c) for c in seen + new]), where)
    state = together(headed(state, top), "level")
    if targets is not None:
        wanted = targets.select("source", "node").distinct().join(places, "source").select("node", "block", *[x.alias(f"t{i}") for i, x in enumerate(own)])
        wanted = written(wanted.groupBy("node", "block").agg(*[F.bit_or(c).alias(c) for c in named("t", WORDS)]), "targets")
    levels = [state]
    while depth is None or len(levels) <= depth:
        go = state.filter(any_of(new)).select("node", "parts", "block", *new)
        if most is not None and len(levels) > 1:  # in the first level each source goes from itself
            go = go.join(big, "node", "left_anti")
        if targets is not None:
            left = wanted.join(state.select("node", "block", *seen), ["node", "block"], "left")
            mask = left.groupBy("block").agg(*[F.bit_or(F.col(f"t{i}").bitwiseAND(F.bitwise_not(F.coalesce(s, zero)))).alias(f"m{i}") for i, s in enumerate(seen)])
            go = go.join(mask, "block").select("node", "parts", "block", *[F.col(c).bitwiseAND(F.col(f"m{i}")).alias(c) for i, c in enumerate(new)]).filter(any_of(new))
        going = go.select(F.explode("parts").alias("part"), F.col("node").alias("_s"), "block", *[zero.alias(c) for c in seen], *new, F.lit(False).alias("own"))
        own_rows = state.select("part", F.col("node").alias("_s"), "block", *seen, *[zero.alias(c) for c in new], F.lit(True).alias("own"))
        both = met(own_rows.unionByName(going), lists).groupBy("part", "node", "block").agg(*[F.bit_or(c).alias(c) for c in seen + new])
        first = [F.col(n).bitwiseAND(F.bitwise_not(F.col(s))) for s, n in zip(seen, new)]
        both = both.select("part", "node", "block", *[F.col(s).bitwiseOR(F.col(n)).alias(s) for s, n in zip(seen, new)], *[x.alias(n) for x, n in zip(first, new)])
        state = together(headed(both, top), "level")
        if state.filter(any_of(new)).isEmpty():
            released(state)
            break
        levels.append(state)
    released(lists, top, where)
    out = None
    for level, table in enumerate(levels):
        rows = set_bits(table.filter(any_of(new)).select("node", "block", *new), new).select("node", "block", "lane", F.lit(level).alias("hops"))
        out = rows if out is None else out.unionByName(rows)
    out = out.join(places, ["block", "lane"]).select("source", "node", "hops")
    return out if targets is None else out.join(targets.select("source", "node").distinct(), ["source", "node"], "left_semi")


def egonets(g: Graph, sources: DataFrame, radius: int, direction: str = "out") -> DataFrame:
    """(source, node, hops) within radius along out-edges, in-edges or either ('all')."""
    e = {"out": g, "in": g.reversed(), "all": Graph(g.undirected_pairs().select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")), g.nodes)}[direction]
    return hops(e, sources, radius)


def nested_egonets(g: Graph, sources: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(source, radius, node): the egonets of every radius from 1 to depth, from one search."""
    return egonets(g, sources, depth, direction).select("source", F.explode(F.sequence(F.greatest("hops", F.lit(1)), F.lit(depth))).alias("radius"), "node")


def layers(g: Graph, sources: DataFrame, depth: int) -> DataFrame:
    """(source, node, hops, parent): the smallest node of the level before that leads there."""
    d = written(hops(g, sources, depth), "hops")
    before = d.select("source", F.col("node").alias("parent"), (F.col("hops") + 1).alias("hops"))
    step = before.join(g.edges.select(F.col("src").alias("parent"), F.col("dst").alias("node")), "parent")
    parent = step.groupBy("source", "node", "hops").agg(F.min("parent").alias("parent"))
    return d.join(parent, ["source", "node", "hops"], "left")


#: Width of a bucket in mean weights: a round costs more in being started than in a few steps
#: that are taken again.
MEANS = 8


def smallest(names: list[str]) -> list[Column]:
    return [F.min(c).alias(c) for c in names]


def weighted_distances(g: Graph, sources: DataFrame, rounds: int = 1000, delta: float | None = None) -> DataFrame:
    """(source, node, distance) over edges with weights, which may be 0; with weights below 0
    too, if no cycle adds up to less than 0 (RuntimeError after so many rounds otherwise).

    A row holds a node and its distances from the sources of a block, a column each. Distances
    are settled in buckets as wide as delta, from the nearest on, empty ones passed over: in a
    bucket only its own rows are joined and written again, along edges lighter than delta, until
    none improves; then its rows go along all edges and into the table, once. delta: by default
    MEANS times the mean weight, or the largest over the mean number of edges of a node if that
    is more.
    With weights below 0, all is one bucket."""
    e = written(g.edges.select(F.col("src").alias("_s"), "dst", "weight").filter("_s <> dst OR weight < 0"), "edges")  # each round reads it
    least, most, mean, count, starts = e.agg(F.min("weight"), F.max("weight"), F.avg("weight"), F.count(F.lit(1)), F.count_distinct("_s")).first()
    if delta is None:
        delta = MEANS * max(mean, most * starts / count) if count and most > 0 else math.inf
    if count and least < 0:
        delta = math.inf
    old, new = named("d"), named("n")
    any_ = lambda names: F.coalesce(*names).isNotNull()
    none = [F.lit(None).cast("double").alias(c) for c in new]
    places = numbering(sources, LANES)
    state = places.select(F.col("source").alias("node"), "block", *[F.when(F.col("lane") == j, 0.0).alias(c) for j, c in enumerate(old)])
    state = state.groupBy("node", "block").agg(*smallest(old))

    def along(front: DataFrame, edges: DataFrame) -> DataFrame:
        # The bound is a column, so that all rounds run the same compiled code.
        sums = [F.when(F.col(c) + F.col("weight") < F.col("bound"), F.col(c) + F.col("weight")).alias(c) for c in old]
        steps = front.join(edges, F.col("node") == F.col("_s")).select(F.col("dst").alias("node"), "block", *sums, "bound").filter(any_(old))
        return steps.groupBy("node", "block").agg(*smallest(old), F.max("bound").alias("bound"))

    # Where a step of rounding is not small beside delta, no edge is surely too long.
    near = delta * (1 + 1e-9)
    short = e if delta == math.inf else written(e.filter(F.col("weight") < near), "light")
    settled, done = -math.inf, 0
    state = written(state.withColumn("bound", F.lit(settled)), "distances")
    while True:
        nearest = state.agg(F.min(F.least(*[F.when(F.col(c) >= F.col("bound"), F.col(c)) for c in old]))).first()[0]
        if nearest is None:
            break
        bound = (math.floor(nearest / delta) + 1) * delta if delta < math.inf else math.inf
        while bound <= nearest:  # where rounding has brought it down
            bound = math.nextafter(bound, math.inf) + delta
        light = short if math.ulp(bound) < delta * 1e-10 and bound - nearest <= near else e
        bucket = state.select("node", "block", *[F.when((F.col(c) >= settled) & (F.col(c) < bound), F.col(c)).alias(c) for c in old], F.lit(bound).alias("bound"))
        bucket = front = written(bucket.filter(any_(old)), "bucket")
        while True:
            reached = along(front, light).select("node", "block", *[F.lit(None).cast("double").alias(c) for c in old], *[F.col(c).alias(n) for c, n in zip(old, new)], "bound")
            both = bucket.select("node", "block", *old, *none, "bound").unionByName(reached).groupBy("node", "block").agg(*smallest(old + new), F.max("bound").alias("bound"))
            better = [F.when(F.col(c).isNull() | (F.col(n) < F.col(c)), F.col(n)).alias(n) for c, n in zip(old, new)]
            both = written(both.select("node", "block", *[F.least(c, n).alias(c) for c, n in zip(old, new)], *better, "bound"), "bucket")
            released(bucket)
            bucket, front = both, both.filter(any_(new)).select("node", "block", *[F.col(n).alias(c) for c, n in zip(old, new)], "bound")
            if front.isEmpty():
                break
            done += 1
            if done > rounds:
                raise RuntimeError(f"distances did not settle in {rounds} rounds")
        own = bucket.select("node", "block", *old, "bound")
        far = along(own.withColumn("bound", F.lit(math.inf)), e).withColumn("bound", F.lit(bound))
        every = state.unionByName(own) if bound == math.inf else state.unionByName(own).unionByName(far)
        new_state = written(every.groupBy("node", "block").agg(*smallest(old), F.max("bound").alias("bound")).withColumn("bound", F.lit(bound)), "distances")
        released(state, bucket)
        state, settled = new_state, bound
        if bound == math.inf:
            break
    lanes = F.array(*[F.struct(F.lit(j).alias("lane"), F.col(c).alias("distance")) for j, c in enumerate(old)])
    rows = state.select("node", "block", F.explode(lanes).alias("x")).select("node", "block", "x.lane", "x.distance").filter("distance IS NOT NULL")
    return rows.join(places, ["block", "lane"]).select("source", "node", "distance")

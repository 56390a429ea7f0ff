"""Outliers by density: how far from its cluster's densest part each row leaves the cluster.

Two rows are as far apart as their distance, or the distance of either to its m-th neighbour
(its core) if that is more. At a threshold, rows linked by such reaches up to it are a cluster
if they are at least m. A row enters the hierarchy at the smallest threshold `eps` at which its
cluster has m rows; with `least` the smallest `eps` in that cluster, its score is
1 - least / eps. That is the score by the condensed tree of a single-linkage hierarchy, as what
a cluster takes in later enters later, so its smallest threshold is there from the start. Equal
reaches count together: a row that enters two clusters at one threshold is held against both.

The hierarchy is a list of rounds. In each, every component goes along its shortest reach to
another; what that joins is a component of the next. Inside a component of round i a row knows
when it `joined`: the longest of the reaches its components went so far. Since a component goes
by its shortest reach, the rows linked with x up to t, if t is less than the reach by which x's
component `leaves`, are those of the component with joined <= t. Neither a tree of the rows nor
a sorted list of all reaches is needed, and ties need no order.

The shortest reach of a component comes from the lists of neighbours while they name a row
outside it that is as near as anything they don't name can be. Otherwise its rows ask the metric
index: cells that hold no row of another component, or only ones too far, are not visited.
Results are exact. Rounds are at most the logarithm of the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lantern.graph import in_order
from lantern.operators.neighbours import PART_ROWS, QUERY_ROWS, Bounds, Part, by_tile, gaps, index, of_index, rows_of
from lantern.plans.components import components
from lantern.session import released, written


#: Rows that ask the index for each time that its rows are dealt out.
ASKS = 10_000


@dataclass(frozen=True)
class Held:
    """What each cell holds of the components: smallest and largest id, smallest core, and of
    the two components whose rows come nearest to the pivot that row's distance and core."""

    first: np.ndarray
    last: np.ndarray
    core: np.ndarray
    who: np.ndarray
    r: np.ndarray
    cores: np.ndarray

    def above(self, d: np.ndarray, core: np.ndarray, component: np.ndarray) -> np.ndarray:
        """For rows at distances d from the pivots: a reach to another component that exists."""
        reach = np.maximum(np.maximum(d[:, :, None] + self.r, self.cores), core[:, None, None])
        return np.where(self.who != component[:, None, None], reach, np.inf).min(axis=(1, 2))


def held_by_cells(here: DataFrame, cells: int) -> Held:
    one = here.groupBy("cell").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.min("core").alias("core")).collect()  # a row per cell
    near = here.groupBy("cell", "component").agg(F.min(F.struct("r", "core")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("n", "component"))
    two = near.withColumn("i", rank).filter("i <= 2").select("cell", "component", "i", "n.r", "n.core").collect()  # two rows per cell
    h = Held(np.full(cells, -1), np.full(cells, -1), np.full(cells, np.inf), np.full((cells, 2), -1), np.full((cells, 2), np.inf), np.full((cells, 2), np.inf))
    for x in one:
        h.first[x["cell"]], h.last[x["cell"]], h.core[x["cell"]] = x["first"], x["last"], x["core"]
    for x in two:
        at = x["cell"], x["i"] - 1
        h.who[at], h.r[at], h.cores[at] = x["component"], x["r"], x["core"]
    return h


class Crowd(Part):
    """The rows of one part with their components and cores. Those of the part's largest
    component are a kind of their own, which that component's rows pass over."""

    def __init__(self, bounds: Bounds, slices: list[pa.RecordBatch]):
        take = lambda c: np.concatenate([s.column(c).to_numpy() for s in slices])
        component, core = take("component"), take("core")
        kinds, count = np.unique(component, return_counts=True)
        self.largest = kinds[count.argmax()]
        super().__init__(bounds, np.concatenate([rows_of(s.column("features")) for s in slices]), take("cell"), (component == self.largest).astype(np.int8), core)
        self.component, self.core = component[self.order], self.by

    def nearest(self, t: pa.RecordBatch) -> pa.RecordBatch | None:
        """(component, reach, other): for the asking rows of each component their shortest
        reach to another one, if within its bound."""
        q, own, core, top = rows_of(t.column("features")), t.column("component").to_numpy(), t.column("core").to_numpy(), t.column("top").to_numpy()
        kinds, code = np.unique(own, return_inverse=True)
        best, other = np.full(len(kinds), np.inf), np.full(len(kinds), -1)
        for these, of in ((own == self.largest, (0,)), (own != self.largest, (0, 1))):
            if not these.any():
                continue
            x, o, c, e = q[these], code[these], core[these], own[these]
            limit = top[these] ** 2

            def changed(near: np.ndarray, who: np.ndarray, size: np.ndarray, rows: slice) -> np.ndarray:
                near = np.maximum(near, np.maximum(self.core[rows] ** 2, c[who, None] ** 2) - size[:, None])
                near[e[who, None] == self.component[rows]] = np.inf
                return near

            for i, j in self.close(x, limit, 1, of, changed):
                apart = e[i] != self.component[j]  # not so only where nothing bounds them
                i, j = i[apart], j[apart]
                reach = np.maximum(np.maximum(self.exact(x, i, j), self.core[j]), c[i])
                first = np.lexsort((reach, o[i]))
                first = first[np.append(True, o[i][first][1:] != o[i][first][:-1])[: len(first)]]
                first = first[reach[first] < best[o[i][first]]]
                best[o[i][first]], other[o[i][first]] = reach[first], self.component[j[first]]
                np.minimum(limit, best[o] ** 2, out=limit)
        got = np.flatnonzero(best < np.inf)
        if len(got):
            return pa.RecordBatch.from_arrays([pa.array(kinds[got]), pa.array(best[got]), pa.array(other[got])], names=["component", "reach", "other"])


def elsewhere(points: DataFrame, bounds: Bounds, labels: DataFrame, asks: DataFrame) -> DataFrame:
    """(component, reach, other): the shortest reach to another component from each component of
    asks (node, component, reach: one known already, or null), where under the one known.

    points (node, features, cell, r, part, core); labels (node, component)."""
    spark = points.sparkSession
    here = written(points.join(labels.select("node", "component"), "node"), "here")
    held = spark.sparkContext.broadcast((bounds, held_by_cells(here, len(bounds.pivots))))  # rows by cell, of which there are PIVOTS at most
    asking = here.join(asks.select("node", "reach"), "node")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_, h = held.value
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(i, QUERY_ROWS)
                d = gaps(rows_of(b.column("features")), b_.pivots)
                yield pa.RecordBatch.from_arrays([b.column("component"), pa.array(h.above(d, b.column("core").to_numpy(), b.column("component").to_numpy()))], names=["component", "top"])

    above = asking.select("component", "core", "features").mapInArrow(bound, "component long, top double").groupBy("component").agg((F.min("top") + F.lit(bounds.room)).alias("top"))
    known = asks.groupBy("component").agg(F.min("reach").alias("reach"))
    tops = written(known.join(above, "component").select("component", F.least("reach", "top").alias("top")), "tops")
    # A row's own reaches are never under its core.
    near = asking.drop("reach").join(tops, "component").filter("core <= top")
    schema = f"query long, {points.select('features').schema.simpleString()[7:-1]}, component long, core double, part int, top double, own int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_, h = held.value
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(i, QUERY_ROWS)
                own, top = b.column("component").to_numpy()[:, None], b.column("top").to_numpy()[:, None]
                d = gaps(rows_of(b.column("features")), b_.pivots)
                floor = b_.floor(d)
                goes = (np.maximum(floor, h.core) <= top) & ((h.first != own) | (h.last != own)) & (b_.high >= b_.low)
                r, part = b_.of_parts(goes)
                rows = b.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("features"), rows.column("component"), rows.column("core"), pa.array(part, pa.int32()), rows.column("top"), pa.array(d.argmin(axis=1)[r], pa.int32())],
                    names=["query", "features", "component", "core", "part", "top", "own"])

    visits = near.select("node", "features", "component", "core", "top").mapInArrow(run, schema)
    base = here.select("node", "features", "cell", "component", "core", "part")
    # For few that ask, base is not dealt out many times.
    most = max(1, -(-asks.count() // ASKS))
    found = by_tile(base, visits, int((bounds.part + bounds.parts).max()), "component long, reach double, other long", lambda slices: Crowd(held.value[0], slices), Crowd.nearest, most)
    out = written(found.groupBy("component").agg(F.min(F.struct("reach", "other")).alias("x")).select("component", "x.*"), "found")
    released(here, tops)
    return out


def hierarchy(points: DataFrame, bounds: Bounds, lists: DataFrame) -> list[DataFrame]:
    """The rounds: (node, component, joined, leaves) each, from every row alone to all in one,
    which never leaves.

    lists (query, node, distance): each row's nearest ones; no row they leave out is nearer than
    the core in points (node, features, cell, r, part, core)."""
    core = lambda end: points.select(F.col("node").alias(end), F.col("core").alias(f"_{end}"))
    reach = F.greatest("distance", "_query", "_node")
    e = lists.filter("query <> node").join(core("query"), "query").join(core("node"), "node").select(F.col("query").alias("u"), F.col("node").alias("v"), reach.alias("reach"))
    e = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "reach")).groupBy("u", "v").agg(F.min("reach").alias("reach")), "reaches")
    labels = written(points.select("node", F.col("node").alias("component"), F.lit(0.0).alias("joined")), "labels")
    levels = []
    while True:
        if labels.agg(F.min("component") == F.max("component")).first()[0]:
            levels.append(labels.withColumn("leaves", F.lit(float("inf"))))
            return levels
        best = written(e.groupBy(F.col("u").alias("component")).agg(F.min(F.struct("reach", F.col("v").alias("other"))).alias("x")).select("component", "x.*"), "best")
        asks = labels.join(best, "component", "left").join(points.select("node", "core"), "node").filter("reach IS NULL OR core < reach")
        asks = written(asks.select("node", "component", "reach"), "asks")
        chosen = best
        if not asks.isEmpty():
            chosen = best.unionByName(elsewhere(points, bounds, labels, asks)).groupBy("component").agg(F.min(F.struct("reach", "other")).alias("x")).select("component", "x.*")
            chosen = written(chosen, "chosen")
        level = written(labels.join(chosen.select("component", F.col("reach").alias("leaves")), "component").select("node", "component", "joined", "leaves"), "level")
        levels.append(level)
        into = written(components(chosen.select(F.col("component").alias("a"), F.col("other").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("new")), "into")
        new = written(level.join(into, "component").select("node", F.col("new").alias("component"), F.greatest("joined", "leaves").alias("joined")), "labels")
        to = lambda end: into.select(F.col("component").alias(end), F.col("new").alias(f"_{end}"))
        f = e.join(to("u"), "u").join(to("v"), "v").filter("_u <> _v").groupBy(F.col("_u").alias("u"), F.col("_v").alias("v")).agg(F.min("reach").alias("reach"))
        f = written(f, "reaches")
        released(e, labels, asks, best, *([chosen] if chosen is not best else []), into)
        e, labels = f, new


def entries(levels: list[DataFrame], m: int) -> DataFrame:
    """(node, level, component, eps): when each row's cluster first has m rows, and where in the
    hierarchy that is. None for rows whose component never has m."""
    found = None
    for i, level in enumerate(levels):
        rank = F.row_number().over(Window.partitionBy("component").orderBy("joined"))
        full = level.select("component", "joined", rank.alias("i")).filter(F.col("i") <= m).filter(F.col("i") == m).select("component", F.col("joined").alias("full"))
        here = level.join(full, "component").withColumn("eps", F.greatest("joined", "full")).filter("eps < leaves").select("node", F.lit(i).alias("level"), "component", "eps")
        found = here if found is None else found.unionByName(here)
    return found.groupBy("node").agg(F.min(F.struct("level", "component", "eps")).alias("x")).select("node", "x.*")


def outlier_scores(rows: DataFrame, m: int = 15, pivots: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, core, eps, least, score) of rows (node, features), a score from 0 (as dense as its
    cluster gets) to 1 (beside rows that lie on each other). Copies of a row, which enter at 0,
    score 0. With fewer than m rows there are no clusters: eps and least are null, scores 0.
    A row's core is the distance of its m-th neighbour, or of the last, if there are fewer."""
    base = rows.select(F.col("node").cast("long").alias("node"), F.col("features").cast("array<double>").alias("features"))
    made = index(base, m + 1, pivots, part_rows)
    if made is None:
        return rows.sparkSession.createDataFrame([], "node long, core double, eps double, least double, score double")
    dealt, bounds = made
    dealt = written(dealt, "dealt")
    lists = written(of_index(dealt.select(F.col("node").alias("query"), "features"), dealt, bounds, m + 1), "lists")
    points = written(dealt.join(lists.groupBy(F.col("query").alias("node")).agg(F.max("distance").alias("core")), "node"), "points")
    levels = hierarchy(points, bounds, lists)
    found = written(entries(levels, m), "entries")
    # The smallest eps among those of a row's component that had joined by its own: a running
    # minimum over (level, component, threshold), those that join at a threshold first.
    asked = found.select("level", "component").distinct()
    sets = None
    for i, level in enumerate(levels):
        here = level.join(found.select("node", "eps"), "node").join(asked.filter(F.col("level") == i).select("component"), "component", "left_semi")
        here = here.select(F.struct(F.lit(i).alias("level"), "component", F.col("joined").alias("t"), F.lit(0).alias("kind")).alias("key"), "eps", F.lit(None).cast("long").alias("node"))
        sets = here if sets is None else sets.unionByName(here)
    ask = found.select(F.struct("level", "component", F.col("eps").alias("t"), F.lit(1).alias("kind")).alias("key"), "eps", "node")
    d = in_order(sets.unionByName(ask), "key").select("_p", "_i", "key.level", "key.component", "eps", "node")
    so_far = Window.partitionBy("_p", "level", "component").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("level", "component").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = d.groupBy("_p", "level", "component").agg(F.min("eps").alias("eps")).withColumn("past", F.min("eps").over(past)).filter("past IS NOT NULL").drop("eps")
    got = d.withColumn("now", F.min("eps").over(so_far)).filter("node IS NOT NULL").join(F.broadcast(carried), ["_p", "level", "component"], "left")  # a row per range: the component that goes on into it
    got = got.select("node", "eps", F.least("now", "past").alias("least"))
    score = F.when(F.col("eps") > 0, 1 - F.col("least") / F.col("eps")).otherwise(0.0)
    return points.select("node", "core").join(got, "node", "left").select("node", "core", "eps", "least", score.alias("score"))

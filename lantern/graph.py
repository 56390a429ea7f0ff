"""A graph as two DataFrames, and the rules by which edge rows become one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.session import written


@dataclass(frozen=True)
class Graph:
    """edges (src long, dst long, weight double), one row per pair; nodes (id long), isolated
    ones included."""

    edges: DataFrame
    nodes: DataFrame

    @staticmethod
    def from_edges(
        edges: DataFrame,
        nodes: DataFrame | int | None = None,
        directed: bool = True,
        weighted: bool = True,
        drop_loops: bool = True,
        combine: str = "max",
        order_by: str | None = None,
    ) -> Graph:
        """Canonical graph of edge rows (src, dst[, weight][, order]).

        Duplicate pairs add up, in unweighted graphs too (multiplicity is a weight); with
        order_by, the row with the largest value of that column wins instead. Undirected
        graphs hold both directions of a pair, with the larger (combine 'max') or the mean
        ('mean') of the directions' weights. nodes: a table of ids, their number (0 .. n-1),
        or None for the ids that edges mention."""
        weight = F.col("weight").cast("double") if weighted and "weight" in edges.columns else F.lit(1.0)
        keep = [F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight")]
        e = edges.select(*keep, *([F.col(order_by).alias("_order")] if order_by else []))
        if drop_loops:
            e = e.filter("src <> dst")
        total = F.max_by("weight", "_order") if order_by else F.sum("weight")
        e = e.groupBy("src", "dst").agg(total.alias("weight"))
        if not directed:
            agg = {"max": F.max, "mean": F.avg}[combine]
            e = e.unionByName(transpose(e)).groupBy("src", "dst").agg(agg("weight").alias("weight"))
        if nodes is None:
            n = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        elif isinstance(nodes, int):
            n = edges.sparkSession.range(nodes)
        else:
            n = nodes.select(F.col("id").cast("long").alias("id"))
        return Graph(e, n)

    def reversed(self) -> Graph:
        return Graph(transpose(self.edges), self.nodes)

    def undirected_pairs(self) -> DataFrame:
        """Distinct (a, b), both ways: who is a neighbour of whom, whatever the direction."""
        e = self.edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def transpose(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def adjacency(e: DataFrame, by: str = "src") -> DataFrame:
    """(id, neighbours array<struct<id, weight>>), by out-edges ('src') or in-edges ('dst')."""
    other = "dst" if by == "src" else "src"
    return e.groupBy(F.col(by).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), "weight"))).alias("neighbours"))


def from_adjacency(a: DataFrame) -> DataFrame:
    return a.select(F.col("id").alias("src"), F.explode("neighbours").alias("x")).select("src", F.col("x.id").alias("dst"), "x.weight")


def in_order(df: DataFrame, by: str) -> DataFrame:
    """df in ranges of column `by`, written: _p the range's number, _i the row's place in it.
    What a total order needs is then a window inside each range, and figures per range."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.repartitionByRange(parts, by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id())
    return written(d.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m"), "ranges")


def before(ranged: DataFrame, total: Column) -> DataFrame:
    """(_p, before, whole): a row per range, the sum of `total` over all ranges before it, and
    over all of them."""
    every = Window.partitionBy(F.lit(1))
    w = every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_p").agg(total.alias("_n"))
    return sums.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("before"), F.sum("_n").over(every).alias("whole"))


def reindex(ids: DataFrame, column: str) -> DataFrame:
    """(column, index): the distinct values in order, numbered from 0. Values are numbered
    inside ranges and the ranges' sizes added up, so no task numbers them all."""
    d = in_order(ids.select(column).filter(F.col(column).isNotNull()).distinct(), column)
    sizes = before(d, F.count(F.lit(1)))  # a row per range
    return d.join(F.broadcast(sizes), "_p").select(column, (F.col("before") + F.col("_i")).cast("long").alias("index"))


def relabel(e: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """Edges whose ends are replaced by their index; edges with an end that has none go."""
    one = lambda end: index.select(F.col(column).alias(end), F.col("index").alias(f"_{end}"))
    return e.join(one("src"), "src").join(one("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def union(g1: Graph, g2: Graph, n1: int) -> Graph:
    """Both graphs side by side, the second's ids from n1 on."""
    e = g2.edges.select((F.col("src") + n1).alias("src"), (F.col("dst") + n1).alias("dst"), "weight")
    return Graph(g1.edges.unionByName(e), g1.nodes.unionByName(g2.nodes.select((F.col("id") + n1).alias("id"))))

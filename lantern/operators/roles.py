"""Egonet features and recursive role features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lantern.graph import Graph
from lantern.operators.degrees import degrees
from lantern.operators.spectral import triangle
from lantern.session import written


def neighbour_pairs(g: Graph) -> DataFrame:
    """(a, b, n, w), a < b: neighbours, the number of edges between them and their weights' sum."""
    e = g.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
    return e.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))


def triangles(pairs: DataFrame) -> DataFrame:
    """(id, n, w): for each corner of each triangle of neighbours the edges opposite to it.
    Pairs go from the node with fewer neighbours to the other; a triangle is two pairs from
    one node and the pair that closes them, so that a hub's neighbours never all meet."""
    size = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    k = lambda end: size.select(F.col("id").alias(end), F.col("k").alias(f"k_{end}"))
    p = pairs.join(k("a"), "a").join(k("b"), "b")
    a, b = F.struct(F.col("k_a").alias("k"), F.col("a").alias("id")), F.struct(F.col("k_b").alias("k"), F.col("b").alias("id"))
    p = written(p.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "n", "w"), "oriented")
    x = p.select("u", F.col("v").alias("v1"), F.col("n").alias("n1"), F.col("w").alias("w1"))
    y = p.select("u", F.col("v").alias("v2"), F.col("n").alias("n2"), F.col("w").alias("w2"))
    t = x.join(y, "u").filter("v1 < v2").join(p.select(F.col("u").alias("v1"), F.col("v").alias("v2"), "n", "w"), ["v1", "v2"])
    corner = lambda c, n, w: F.struct(F.col(f"{c}.id").alias("id"), F.col(n).alias("n"), F.col(w).alias("w"))
    return t.select(F.explode(F.array(corner("u", "n", "w"), corner("v1", "n2", "w2"), corner("v2", "n1", "w1"))).alias("t")).select("t.*")


def egonet_features(g: Graph, weights: bool = False) -> DataFrame:
    """id, internal, outgoing, incoming: edges inside a node's egonet (itself and its
    neighbours of either direction), out of it and into it; with weights, their sums too.
    Inside are a node's own edges and, by triangles, those between its neighbours; what leaves
    or enters is what the members' degrees leave of it."""
    e = Graph(g.edges.filter("src <> dst"), g.nodes)
    pairs = written(neighbour_pairs(e), "pairs")
    own = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("member")), F.struct(F.col("b").alias("id"), F.col("a").alias("member")))).alias("x"), "n", "w").select("x.*", "n", "w")
    inside = own.select("id", "n", "w").unionByName(triangles(pairs)).groupBy("id").agg(F.sum("n").alias("internal"), F.sum("w").alias("w_internal"))
    d = written(e.edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("weight").alias("wo"), F.lit(0.0).alias("wi")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0.0).alias("wo"), F.col("weight").alias("wi")),
    )).alias("x")).select("x.*").groupBy("id").agg(*[F.sum(c).alias(c) for c in ("o", "i", "wo", "wi")]), "ends")
    members = own.select("id", "member").join(d.withColumnRenamed("id", "member"), "member").drop("member").unionByName(d)
    ends = members.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("o", "i", "wo", "wi")])
    all_ = g.nodes.join(inside, "id", "left").join(ends, "id", "left").na.fill(0)
    out = all_.select("id", "internal", (F.col("o") - F.col("internal")).alias("outgoing"), (F.col("i") - F.col("internal")).alias("incoming"), "w_internal", (F.col("wo") - F.col("w_internal")).alias("w_outgoing"), (F.col("wi") - F.col("w_internal")).alias("w_incoming"))
    return out if weights else out.select("id", "internal", "outgoing", "incoming")


def base_features(g: Graph, weights: bool = False) -> DataFrame:
    """(node, col, value): degrees, then egonet features."""
    d, e = degrees(g), egonet_features(g, weights)
    names = ["n_out", "n_in"] + (["w_out", "w_in"] if weights else []) + [c for c in e.columns if c != "id"]
    wide = d.join(e, "id")
    return long(wide.select(F.col("id").alias("node"), *names), names)


def long(wide: DataFrame, names: list[str]) -> DataFrame:
    parts = F.array(*[F.struct(F.lit(i).alias("col"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)])
    return wide.select("node", F.explode(parts).alias("x")).select("node", "x.col", "x.value")


def neighbour_step(g: Graph, features: DataFrame, width: int) -> DataFrame:
    """(node, col, value): mean, then sum over neighbours of each column, columns scaled to
    length 1 (a column of zeros stays)."""
    pairs = g.undirected_pairs().select(F.col("a"), F.col("b").alias("node"))
    s = pairs.join(features, "node").groupBy(F.col("a").alias("node"), "col").agg(F.avg("value").alias("m"), F.sum("value").alias("s"))
    new = s.select("node", F.col("col"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("m").alias("value")), F.struct(F.lit(1).alias("k"), F.col("s").alias("value")))).alias("x"))
    new = new.select("node", (F.col("col") + F.col("x.k") * width).alias("col"), "x.value")
    size = new.groupBy("col").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
    new = new.join(F.broadcast(size), "col").select("node", "col", F.when(F.col("size") > 0, F.col("value") / F.col("size")).otherwise(0.0).alias("value"))  # a row a column
    every = features.select("node", F.explode(F.array(F.col("col"), F.col("col") + width)).alias("col"))
    return every.join(new, ["node", "col"], "left").select("node", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def kept_columns(features: DataFrame, width: int, tol: float) -> list[bool]:
    """Columns whose part that earlier columns do not explain is over tol of their size, by the
    triangular factor of the table of nodes and columns: only that, width x width, comes to the
    driver, and a part's size is found to rounding, not to its root."""
    cells = F.array_sort(F.collect_list(F.struct("col", "value")))
    table = features.groupBy("node").agg(cells.alias("c"))
    empty = F.array_repeat(F.lit(0.0), width)
    by_col = F.map_from_entries("c")
    full = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(by_col[i], F.lit(0.0)))
    rows = table.select(F.when(F.size("c") == width, F.transform("c", lambda x: x["value"])).when(F.size("c") == 0, empty).otherwise(full).alias("x"))
    r = triangle(rows, width)
    return [bool(abs(r[j, j]) > tol * max(np.abs(r[:, j]).max(), 1e-300)) for j in range(width)]


def role_features(g: Graph, size: int = 128, tol: float = 1e-6, weights: bool = False, masks: dict[int, list[bool]] | None = None) -> tuple[DataFrame, dict[int, list[bool]]]:
    """((node, col, value), masks): base features, and for up to log2(1 + size / base) - 1
    steps the neighbours' means and sums that are not explained by what is there. masks of an
    earlier run are followed instead, so that another graph gets the same columns."""
    f = written(base_features(g, weights), "roles")
    width = 10 if weights else 5
    n = g.nodes.count()
    used: dict[int, list[bool]] = {}
    for step in range(max(0, int(math.log2(1 + size / width)) - 1)):
        if masks is not None and step not in masks or masks is None and 3 * width > n:
            break
        both = written(f.unionByName(neighbour_step(g, f, width).withColumn("col", F.col("col") + width)), "roles")
        keep = masks[step] if masks is not None else kept_columns(both, 3 * width, tol)
        if not any(keep[width:]):
            break
        used[step] = keep
        new = {c: i for i, c in enumerate(c for c, k in enumerate(keep) if k)}
        at = F.create_map(*[F.lit(x) for kv in new.items() for x in kv])
        f = written(both.filter(F.col("col").isin(list(new))).select("node", at[F.col("col")].alias("col"), "value"), "roles")
        width = len(new)
    return f, used

"""Laplacians and walk matrices as (row, col, value). An edge src -> dst is the entry
(row dst, col src); zero entries are left out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lantern.graph import Graph
from lantern.operators.degrees import degrees, inverse
from lantern.session import written


def entries(diagonal: DataFrame, rest: DataFrame, names: tuple[str, ...] = ("value",)) -> DataFrame:
    both = diagonal.unionByName(rest).groupBy("row", "col").agg(*[F.sum(n).alias(n) for n in names])
    keep = F.lit(False)
    for n in names:
        keep = keep | (F.abs(n) > 1e-15)
    return both.filter(keep)


def random_walk(g: Graph, by: str = "out") -> DataFrame:
    """out: diag(d > 0) - A / d_out by columns; in: diag(d_in > 0) - A / d_in by rows."""
    d = degrees(g).select("id", F.col(f"w_{by}").alias("d"))
    diagonal = d.filter("d > 0").select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))
    end = "src" if by == "out" else "dst"
    rest = g.edges.join(d, F.col(end) == F.col("id")).select(F.col("dst").alias("row"), F.col("src").alias("col"), (-F.col("weight") * inverse(F.col("d"))).alias("value"))
    return entries(diagonal, rest)


def symmetric(g: Graph, isolated: bool = False) -> DataFrame:
    """diag(d_in > 0 and d_out > 0) - D_in^-1/2 A D_out^-1/2. isolated: the identity on
    every node, and out-degrees on both sides, as 2018's wavelets take it."""
    d = degrees(g)
    on = F.lit(True) if isolated else (F.col("w_in") > 0) & (F.col("w_out") > 0)
    diagonal = d.filter(on).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))
    root = lambda side, name: d.select(F.col("id").alias(name), inverse(F.col(f"w_{side}"), 0.5).alias(f"r_{name}"))
    rest = g.edges.join(root("out", "src"), "src").join(root("out" if isolated else "in", "dst"), "dst")
    rest = rest.select(F.col("dst").alias("row"), F.col("src").alias("col"), (-F.col("weight") * F.col("r_src") * F.col("r_dst")).alias("value"))
    return entries(diagonal, rest)


def magnetic_parts(g: Graph, q: float) -> DataFrame:
    """(row, col, a, re, im): half the sum of both directions' weights, and the phase
    exp(2 pi i q (A[row, col] - A[col, row]))."""
    e = g.edges.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("weight").alias("x"), F.lit(0.0).alias("y"))
    both = e.unionByName(g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(0.0).alias("x"), F.col("weight").alias("y")))
    s = both.groupBy("row", "col").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    angle = 2 * math.pi * q * (F.col("x") - F.col("y"))
    return s.select("row", "col", ((F.col("x") + F.col("y")) / 2).alias("a"), F.cos(angle).alias("re"), F.sin(angle).alias("im"))


def magnetic(g: Graph, q: float = 0.25, normalised: bool = False) -> DataFrame:
    """(row, col, re, im): D - A_s * phase, or I - D^-1/2 A_s D^-1/2 * phase."""
    m = magnetic_parts(g, q)
    d = m.groupBy(F.col("col").alias("id")).agg(F.sum("a").alias("d"))
    one = F.lit(1.0) if normalised else F.col("d")
    diagonal = d.filter("d > 0").select(F.col("id").alias("row"), F.col("id").alias("col"), one.alias("re"), F.lit(0.0).alias("im"))
    a = -F.col("a")
    if normalised:
        root = lambda name: d.select(F.col("id").alias(name), inverse(F.col("d"), 0.5).alias(f"r_{name}"))
        m, a = m.join(root("row"), "row").join(root("col"), "col"), -F.col("a") * F.col("r_row") * F.col("r_col")
    return entries(diagonal, m.select("row", "col", (a * F.col("re")).alias("re"), (a * F.col("im")).alias("im")), ("re", "im"))


def walk(g: Graph) -> DataFrame:
    """(src, dst, p): the column-stochastic walk, nodes without out-edges staying put. It is
    the identity minus random_walk(g)."""
    d = degrees(g).select(F.col("id").alias("src"), "w_out")
    stay = d.filter("w_out <= 0").select("src", F.col("src").alias("dst"), F.lit(1.0).alias("p"))
    return g.edges.join(d, "src").filter("w_out > 0").select("src", "dst", (F.col("weight") / F.col("w_out")).alias("p")).unionByName(stay)


def walk_parts(g: Graph) -> tuple[DataFrame, DataFrame | None]:
    """walk(g) before p is divided: (src, dst, p), and (id, total) to divide by. Edges are not
    dealt out for it; a node that stays put has p and total 1. Where weights below 0 leave a node
    with edges nothing to divide by, walk(g) and None."""
    d = written(degrees(g).select("id", "n_out", "w_out"), "degrees")
    if not d.filter("w_out <= 0 AND n_out > 0").isEmpty():
        return walk(g), None
    stay = d.filter("w_out <= 0").select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("p"))
    totals = d.select("id", F.when(F.col("w_out") > 0, F.col("w_out")).otherwise(1.0).alias("total"))
    return g.edges.select("src", "dst", F.col("weight").alias("p")).unionByName(stay), totals


def norms(m: DataFrame) -> DataFrame:
    """One row: the largest column sum and the largest row sum of absolute values."""
    by = lambda c: m.groupBy(c).agg(F.sum(F.abs("value")).alias("s")).agg(F.max("s").alias(f"norm_{c}"))
    return by("col").join(by("row"))  # one row with one row

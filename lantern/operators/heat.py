"""Heat diffusion from many sources at once, and what its distribution tells of a source.

psi_tau(s, v) is the chance that a walker who leaves s and takes a Poisson(tau) number of
steps is at v. A step is a join of the walkers' places with the walk and a sum, for many
sources and all tau in one row (lantern.operators.lanes). Every CUT steps the state is written
in the shared folder: plans stay short and a lost executor costs a few steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lantern.functions import angles, coefficients
from lantern.graph import Graph
from lantern.operators import laplacian
from lantern.operators.degrees import betas, degrees, flat_thetas, thetas
from lantern.operators.lanes import CUT, chebyshev, moves, polynomial
from lantern.operators.paths import hops
from lantern.session import written

#: Values this near a threshold count as reaching it.
TIE = 1 - 1e-12


def by_tau(lanes: DataFrame) -> DataFrame:
    return lanes.select("source", "node", F.col("t").alias("tau"), F.col("value").alias("psi"))


def heat_kernel(g: Graph, taus: list[float], order: int = 20, sources: DataFrame | None = None) -> DataFrame:
    """(source, node, tau (number in taus), psi), zeros left out."""
    start = g.nodes if sources is None else sources
    steps, totals = laplacian.walk_parts(g)
    return by_tau(polynomial(steps, start, [coefficients.poisson(t, order) for t in taus], totals))


def heat_kernel_chebyshev(g: Graph, taus: list[float], order: int = 20, sources: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """The kernel by Chebyshev polynomials of L - 1; accurate for undirected graphs.
    symmetric: of the symmetric Laplacian with the identity on isolated nodes."""
    lap = laplacian.symmetric(g, isolated=True) if symmetric else laplacian.random_walk(g)
    minus = g.nodes.select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(-1.0).alias("value"))
    x = written(laplacian.entries(minus, lap), "x")
    start = g.nodes if sources is None else sources
    return by_tau(chebyshev(x, g.nodes, start, [coefficients.chebyshev(t, order) for t in taus]))


def threshold(psi: DataFrame, theta: DataFrame) -> DataFrame:
    """psi where it reaches its source's theta, ties (to rounding) included."""
    t = theta.select(F.col("id").alias("source"), "theta")
    return psi.join(t, "source").filter(F.abs("psi") >= F.col("theta") * TIE).drop("theta")


def star_normalised(g: Graph, psi: DataFrame, taus: list[float], most: int | None = None) -> DataFrame:
    """psi over the heat that an ideal star around the source has at the same distance."""
    d = hops(g, psi.select(F.col("source").alias("id")).distinct(), most=most)
    own = betas(g).select(F.col("id").alias("source"), F.col("n_out").alias("arms"), "beta")
    ends = degrees(g).select(F.col("id").alias("node"), F.col("n_out").alias("branch"))
    all_ = psi.join(d, ["source", "node"], "left").join(own, "source").join(ends, "node")
    star = F.lit(None).cast("double")
    for i, t in enumerate(taus):
        star = F.when(F.col("tau") == i, angles.star_log_heat(F.col("hops"), F.col("branch"), F.col("arms"), F.col("beta"), t)).otherwise(star)
    return all_.select("source", "node", "tau", F.exp(F.ln("psi") - star).alias("psi"))


def characteristic(x: DataFrame, g: Graph, points: list[float], n_tau: int, sources: DataFrame | None = None) -> DataFrame:
    """(source, tau, t, re, im): the empirical characteristic function, over all nodes, of
    the angles x (source, node, tau, angle) of each source (by default every node); nodes
    without a row have angle 0."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    every = (g.nodes if sources is None else sources).select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(n_tau - 1))).alias("tau"))
    sums = [F.coalesce(F.sum(f(F.lit(float(t)) * F.col("angle"))), F.lit(0.0)).alias(f"{name}{i}") for i, t in enumerate(points) for name, f in (("c", F.cos), ("s", F.sin))]
    s = x.select("source", "tau", "angle").unionByName(every, allowMissingColumns=True).groupBy("source", "tau").agg(F.count("angle").alias("k"), *sums)
    s = s.join(F.broadcast(n))  # one row
    parts = F.array(*[F.struct(F.lit(i).alias("t"), ((F.col("n") - F.col("k") + F.col(f"c{i}")) / F.col("n")).alias("re"), (F.col(f"s{i}") / F.col("n")).alias("im")) for i in range(len(points))])
    return s.select("source", "tau", F.explode(parts).alias("p")).select("source", "tau", "p.t", "p.re", "p.im")


@dataclass(frozen=True)
class Parameters:
    """Of an embedding with about `size` columns, heat up to `radius`."""

    size: int = 128
    radius: int = 3
    order: int = 20
    transpose: bool = False
    aggregate: bool = False
    normalise: bool = False
    log: bool = True

    @property
    def multiple(self) -> int:
        return 2 * 2**self.transpose * 2**self.aggregate

    @property
    def n_tau(self) -> int:
        return int((self.size / self.multiple) ** (1 / 3) + 0.01) if self.radius > 1 else 1

    @property
    def n_points(self) -> int:
        return int(self.size / self.multiple / self.n_tau)

    @property
    def taus(self) -> list[float]:
        return coefficients.linspace(1.0, float(self.radius), self.n_tau)

    def __post_init__(self):
        if self.size < self.multiple or self.radius < 0:
            raise ValueError("size is under one column for each part, or radius under 0")


def wavelet_preset(n: int, size: int = 100) -> dict:
    """taus and points of embed_2018() for an undirected graph of n nodes: its two legacy
    scales, and size / 4 points from 0 to 100."""
    k = max(1, size // 4)
    return {"taus": list(coefficients.legacy_scales(n)), "points": coefficients.linspace(0.0, 100.0, k)}


def magnetic_preset(size: int = 200) -> dict:
    """taus, points and q of embed_magnetic(): 10 points, size / 20 scales from 2 to 20."""
    return {"taus": coefficients.linspace(2.0, 20.0, max(1, size // 20)), "points": coefficients.linspace(1.0, 10.0, 10), "q": 0.02}


def to_angle(p: Parameters) -> Column:
    # The log form is not used on normalised heat, and alone needs values up to its top.
    if p.log and not p.normalise:
        return angles.log_arctan(F.least(F.col("psi"), F.lit(1.0)), 1.0)
    return angles.linear(F.col("psi"), 10.0 if p.normalise else 1.0)


def neighbour_mean(g: Graph, long: DataFrame) -> DataFrame:
    """(node, col, value): the mean over a node's distinct neighbours, of either direction, of
    (node, col, value); 0 for a node without any."""
    pairs = g.undirected_pairs().select(F.col("a"), F.col("b").alias("node"))
    mean = pairs.join(long, "node").groupBy(F.col("a").alias("node"), "col").agg(F.avg("value").alias("value"))
    every = long.select("node", "col", F.lit(0.0).alias("zero"))
    return every.join(mean, ["node", "col"], "left").select("node", "col", F.coalesce("value", "zero").alias("value"))


def enhanced(g: Graph, long: DataFrame, columns: int) -> DataFrame:
    """long with the neighbours' means behind it, as columns `columns` and on."""
    long = written(long, "features")
    return long.unionByName(neighbour_mean(g, long).withColumn("col", F.col("col") + columns))


def columns_of(ecf: DataFrame, p: Parameters, first: int) -> DataFrame:
    at = F.lit(first) + F.col("tau") * (2 * p.n_points) + 2 * F.col("t")
    pair = F.array(F.struct(at.alias("col"), F.col("re").alias("value")), F.struct((at + 1).alias("col"), F.col("im").alias("value")))
    return ecf.select(F.col("source").alias("node"), F.explode(pair).alias("x")).select("node", F.col("x.col").cast("int").alias("col"), "x.value")


def embed(g: Graph, p: Parameters, kernel=heat_kernel, flat: bool = False, selected: DataFrame | None = None) -> DataFrame:
    """(node, col, value): structural embedding by heat. Per tau the pairs re, im of each
    point; then the same on the reversed graph; then the neighbours' mean of it all.
    selected (id): the nodes wanted; heat then starts from them alone, and their neighbours."""
    width = p.n_tau * 2 * p.n_points
    out, sources = None, None
    if selected is not None:
        near = g.undirected_pairs().join(selected.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        sources = written(selected.select("id").unionByName(near).distinct() if p.aggregate else selected.select("id").distinct(), "sources")
    for i, h in enumerate([g, g.reversed()] if p.transpose else [g]):
        psi = kernel(h, p.taus, p.order, sources)
        psi = threshold(psi, flat_thetas(h) if flat else thetas(h, p.radius))
        if p.normalise:
            psi = star_normalised(h, psi, p.taus)
        x = psi.select("source", "node", "tau", to_angle(p).alias("angle"))
        long = columns_of(characteristic(x, h, [float(t) for t in range(1, p.n_points + 1)], p.n_tau, sources), p, i * width)
        out = long if out is None else out.unionByName(long)
    out = enhanced(g, out, width * (2 if p.transpose else 1)) if p.aggregate else out
    return out if selected is None else out.join(selected.select(F.col("id").alias("node")), "node", "left_semi")


def embed_undirected(g: Graph, p: Parameters, selected: DataFrame | None = None) -> DataFrame:
    """The embedding with Chebyshev diffusion on an undirected graph."""
    return embed(g, p, heat_kernel_chebyshev, selected=selected)


def embed_2018(g: Graph, taus: list[float], points: list[float], order: int = 30) -> DataFrame:
    """(source, tau, t, re, im): wavelets of the symmetric Laplacian, values up to 1e-4/n
    dropped, no angle transform."""
    psi = heat_kernel_chebyshev(g, taus, order, symmetric=True)
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    kept = psi.join(F.broadcast(n)).filter(F.col("psi") > 1e-4 / F.col("n"))  # one row
    return characteristic(kept.withColumn("angle", F.col("psi")), g, points, len(taus))


def magnetic_kernel(g: Graph, taus: list[float], q: float, order: int = 30) -> DataFrame:
    """(source, node, tau, re, im) of exp(-tau L_q) by uniformisation: with u at least every
    diagonal entry, exp(-tau L) is the Poisson(u tau) mixture of powers of 1 - L / u."""
    lap = written(laplacian.magnetic(g, q), "magnetic")
    u = max(1e-12, 2 * (lap.filter("row = col").agg(F.max("re")).first()[0] or 0.0))
    step = lap.select(F.col("col").alias("_s"), F.col("row").alias("dst"), (-F.col("re") / u).alias("pr"), (-F.col("im") / u).alias("pi"))
    one = g.nodes.select(F.col("id").alias("_s"), F.col("id").alias("dst"), F.lit(1.0).alias("pr"), F.lit(0.0).alias("pi"))
    step = moves(step.unionByName(one).groupBy("_s", "dst").agg(F.sum("pr").alias("pr"), F.sum("pi").alias("pi")), g.nodes, "pr", "pi")
    need = order + int(u * max(taus) + 6 * math.sqrt(u * max(taus)))
    weights = [coefficients.poisson(u * t, need) for t in taus]
    state = g.nodes.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(1.0).alias("xr"), F.lit(0.0).alias("xi"), *[F.lit(w[0]).alias(f"r{i}") for i, w in enumerate(weights)], *[F.lit(0.0).alias(f"i{i}") for i in range(len(taus))])
    names = [f"{c}{i}" for i in range(len(taus)) for c in "ri"]
    for k in range(1, need):
        real, imaginary = F.col("xr") * F.col("pr") - F.col("xi") * F.col("pi"), F.col("xr") * F.col("pi") + F.col("xi") * F.col("pr")
        kept = [F.sum(F.when(F.col("keep"), F.col(c)).otherwise(0.0)).alias(c) for c in names]
        s = state.join(step, F.col("node") == F.col("_s")).groupBy("source", F.col("dst").alias("node")).agg(F.sum(real).alias("xr"), F.sum(imaginary).alias("xi"), *kept)
        more = [(F.col(f"{c}{i}") + F.lit(weights[i][k]) * F.col(f"x{c}")).alias(f"{c}{i}") for i in range(len(taus)) for c in "ri"]
        state = s.select("source", "node", "xr", "xi", *more)
        if k % CUT == 0:
            state = written(state, "magnetic")
    parts = F.array(*[F.struct(F.lit(i).alias("tau"), F.col(f"r{i}").alias("re"), F.col(f"i{i}").alias("im")) for i in range(len(taus))])
    return state.select("source", "node", F.explode(parts).alias("p")).select("source", "node", "p.tau", "p.re", "p.im")


def embed_magnetic(g: Graph, taus: list[float], points: list[float], q: float = 0.02, order: int = 30) -> DataFrame:
    """(source, tau, t, re, im): mean over all nodes of exp(i t z) of complex heat z."""
    z = magnetic_kernel(g, taus, q, order)
    n = g.nodes.agg(F.count(F.lit(1)).alias("n"))
    sums = [F.sum(F.exp(-t * F.col("im")) * f(t * F.col("re"))).alias(f"{name}{i}") for i, t in enumerate(points) for name, f in (("c", F.cos), ("s", F.sin))]
    s = z.groupBy("source", "tau").agg(F.count(F.lit(1)).alias("k"), *sums).join(F.broadcast(n))  # one row
    parts = F.array(*[F.struct(F.lit(i).alias("t"), ((F.col("n") - F.col("k") + F.col(f"c{i}")) / F.col("n")).alias("re"), (F.col(f"s{i}") / F.col("n")).alias("im")) for i in range(len(points))])
    return s.select("source", "tau", F.explode(parts).alias("p")).select("source", "tau", "p.t", "p.re", "p.im")

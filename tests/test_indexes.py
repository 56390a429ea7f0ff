"""Nearest rows by cells, search by bits and heat by lanes against brute force."""

import math

import numpy as np
import pytest

from lantern.functions import coefficients
from lantern.graph import Graph
from lantern.operators import heat, lanes, neighbours, paths


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>").repartition(3)


def slow_nearest(x, queries, k):
    out = []
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out += [(q, r + 1, int(i)) for r, i in enumerate(np.lexsort((np.arange(len(x)), d))[:k])]
    return sorted(out)


def kinds_of_rows():
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 5)) * 20
    near = centres[r.integers(0, 12, 400)] + r.normal(size=(400, 5))
    hot = np.concatenate([near, np.tile(near[3], (200, 1))])  # a third of all rows are one
    return {"clusters": near, "hot": hot, "grid": r.integers(0, 4, (300, 2)).astype(float), "flat": np.zeros((50, 3)), "line": np.arange(200.0)[:, None], "far": near + 1e8}


@pytest.mark.parametrize("name", list(kinds_of_rows()))
def test_nearest_by_cells_is_exact(spark, name):
    x = kinds_of_rows()[name]
    queries = list(range(0, len(x), 13))
    df = frame(spark, x)
    got = neighbours.nearest(df.filter("node % 13 = 0"), df, 7, part_rows=40)
    assert sorted((r.query, r["rank"], r.node) for r in got.collect()) == slow_nearest(x, queries, 7)


def test_nearest_leaves_far_cells_out(spark):
    x = kinds_of_rows()["clusters"]
    df = frame(spark, x)
    rows, bounds = neighbours.index(df, 5, part_rows=20)
    assert rows.count() == len(x)  # base is dealt out once
    went = neighbours.visits(df.withColumnRenamed("node", "query"), bounds, 5).selectExpr("size(cells) AS n").groupBy().sum("n").first()[0]
    assert went < 0.35 * len(x) * len(bounds.pivots)


def test_nearest_of_few_or_no_rows(spark):
    df = frame(spark, np.arange(3.0)[:, None])
    assert sorted((r.query, r["rank"], r.node) for r in neighbours.nearest(df, df, 10).collect()) == slow_nearest(np.arange(3.0)[:, None], [0, 1, 2], 10)
    assert neighbours.nearest(df.limit(0), df, 2).count() == 0
    assert neighbours.nearest(df, df.limit(0), 2).count() == 0


def test_crowded_cells_have_parts_of_their_own():
    first, count = neighbours.packed(np.array([3, 25, 4, 5, 9, 1]), np.arange(6), 10)
    assert first.tolist() == [0, 1, 4, 4, 5, 5] and count.tolist() == [1, 3, 1, 1, 1, 1]


def random_graph(spark, n=90, m=260, seed=1):
    r = np.random.default_rng(seed)
    pairs = sorted({(int(a), int(b)) for a, b in r.integers(0, n, (m, 2)) if a != b})
    e = spark.createDataFrame([(a, b, 1.0 + (a * b) % 3) for a, b in pairs], "src long, dst long, weight double")
    return Graph.from_edges(e, n), pairs


def slow_hops(pairs, source, depth=10**9, most=10**9):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    seen, front, level = {source: 0}, [source], 0
    while front and level < depth:
        level += 1
        new = {b for a in front if a == source or len(out.get(a, ())) < most for b in out.get(a, ())} - set(seen)
        seen |= dict.fromkeys(new, level)
        front = list(new)
    return seen


@pytest.mark.parametrize("depth,most", [(None, None), (2, None), (None, 5), (0, None)])
def test_search_by_bits(spark, monkeypatch, depth, most):
    monkeypatch.setattr(lanes, "NUMBERED", 20)  # several numbering tasks, so several blocks
    g, pairs = random_graph(spark)
    got = {(r.source, r.node): r.hops for r in paths.hops(g, g.nodes, depth, most).collect()}
    want = {(s, v): h for s in range(90) for v, h in slow_hops(pairs, s, 10**9 if depth is None else depth, most or 10**9).items()}
    assert got == want


def test_search_past_one_row_of_bits(spark):
    n = 300  # a ring, all nodes sources
    g = Graph.from_edges(spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long"), n)
    got = {(r.source, r.node): r.hops for r in paths.hops(g, g.nodes, 3).collect()}
    assert got == {(i, (i + h) % n): h for i in range(n) for h in range(4)}


def test_search_for_targets(spark):
    g, pairs = random_graph(spark)
    targets = [(s, t) for s in range(0, 90, 9) for t in range(s % 7, 90, 30)]
    got = {(r.source, r.node): r.hops for r in paths.hops(g, g.nodes.filter("id % 9 = 0"), targets=spark.createDataFrame(targets, "source long, node long")).collect()}
    assert got == {(s, t): h for s, t in targets if (h := slow_hops(pairs, s).get(t)) is not None}


def dense_walk(pairs, n=90):
    w = np.zeros((n, n))
    for a, b in pairs:
        w[b, a] = 1.0 + (a * b) % 3
    total = w.sum(axis=0)
    return np.where(total > 0, w / np.where(total > 0, total, 1), np.eye(n))


@pytest.mark.parametrize("taus", [[1.0], [0.5, 1.0, 4.0], [0.1 * i for i in range(1, 20)]])
def test_heat_by_lanes(spark, taus):
    g, pairs = random_graph(spark)
    p = dense_walk(pairs)
    got = np.zeros((len(taus), 90, 90))
    for r in heat.heat_kernel(g, taus, 12, g.nodes.filter("id % 4 = 0")).collect():
        got[r.tau, r.node, r.source] = r.psi
    for i, t in enumerate(taus):
        want = sum(c * np.linalg.matrix_power(p, k) for k, c in enumerate(coefficients.poisson(t, 12)))
        want[:, np.arange(90) % 4 != 0] = 0
        assert np.allclose(got[i], want, atol=1e-12)


def test_chebyshev_by_lanes(spark):
    g, pairs = random_graph(spark)
    g = Graph.from_edges(g.edges, g.nodes, directed=False)
    got = np.zeros((2, 90, 90))
    for r in heat.heat_kernel_chebyshev(g, [1.0, 3.0], 30, symmetric=True).collect():
        got[r.tau, r.node, r.source] = r.psi
    a = np.zeros((90, 90))
    for r in g.edges.collect():
        a[r.src, r.dst] = r.weight
    d = a.sum(axis=0)
    lap = np.eye(90) - a / np.sqrt(np.outer(np.maximum(d, 1e-300), np.maximum(d, 1e-300)))
    values, vectors = np.linalg.eigh(lap)
    for i, t in enumerate([1.0, 3.0]):
        assert np.allclose(got[i], vectors @ np.diag(np.exp(-t * values)) @ vectors.T, atol=1e-8)


def test_sources_given_twice_count_once(spark):
    g, _ = random_graph(spark)
    s = g.nodes.filter("id = 3")
    assert math.isclose(sum(r.psi for r in heat.heat_kernel(g, [1.0], 6, s.union(s)).collect()), sum(coefficients.poisson(1.0, 6)))


def test_series_and_their_bounds():
    r = np.random.default_rng(2)
    a = r.uniform(size=(30, 30))
    a /= np.abs(a).sum(axis=0).max()
    values, vectors = np.linalg.eig(a)
    for tau, order in ((0.5, 3), (1.0, 6), (3.0, 12)):
        exact = (vectors * np.exp(-tau * values) @ np.linalg.inv(vectors)).real
        series, power = np.zeros_like(a), np.eye(30)
        for c in coefficients.power_series(tau, order):
            series, power = series + c * power, power @ a
        error = np.abs(series - exact).sum(axis=0).max()
        assert 0 < error <= coefficients.exponential_bound(30, order, tau)
        assert error / np.abs(exact).sum(axis=0).max() <= coefficients.exponential_bound(30, order, tau, relative=True)
    assert coefficients.rounding(1000, 10) == pytest.approx(1e4 * 2.0**-52)
    few = coefficients.chebyshev_on_order(2.0, 20)
    assert len(few) == 21 and np.allclose(few[:20], coefficients.chebyshev(2.0, 20), atol=1e-12) and abs(few[20]) < 1e-12

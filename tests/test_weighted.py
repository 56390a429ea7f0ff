"""Weighted distances in buckets against relaxation by hand."""

import numpy as np
import pytest

from lantern.graph import Graph
from lantern.operators.paths import weighted_distances


def relaxed(edges, source):
    best = {source: 0.0}
    for _ in range(200):
        for a, b, w in edges:
            if a in best and best[a] + w < best.get(b, float("inf")) - 1e-12:
                best[b] = best[a] + w
    return best


def check(spark, edges, sources, **options):
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long, weight double"), drop_loops=False)
    ids = spark.createDataFrame([(s,) for s in sources], "id long")
    got = {(r["source"], r["node"]): r["distance"] for r in weighted_distances(g, ids, **options).collect()}
    want = {(s, n): d for s in sources for n, d in relaxed(edges, s).items()}
    assert set(got) == set(want)
    for k, d in want.items():
        assert got[k] == pytest.approx(d, abs=1e-9)


def random_edges(seed, n, m, weights):
    rng = np.random.default_rng(seed)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, size=(m, 2))})
    return [(a, b, float(w)) for (a, b), w in zip(pairs, weights(rng, len(pairs)))]


def test_default_buckets_and_blocks(spark):
    """More sources than a block holds; heavy and light edges, zeros among them."""
    edges = random_edges(1, 20, 50, lambda r, n: np.where(r.random(n) < 0.2, 0.0, r.exponential(2.0, n)))
    check(spark, edges, list(range(18)))


def test_width_under_the_weights(spark):
    check(spark, random_edges(2, 12, 24, lambda r, n: r.integers(1, 4, n) / 2), [0, 3], delta=0.8)


def test_long_gap_is_passed_over(spark):
    """Two clusters 1e6 apart, with a delta of 1: as many buckets as hold rows."""
    check(spark, [(0, 1, 0.5), (1, 2, 1e6), (2, 3, 0.5)], [0], delta=1.0)


def test_below_zero(spark):
    check(spark, [(0, 1, 4.0), (0, 2, 1.0), (2, 1, -3.0), (1, 3, 1.0)], [0, 2])
    g = Graph.from_edges(spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, weight double"))
    with pytest.raises(RuntimeError):
        weighted_distances(g, g.nodes, rounds=4)


def test_no_edges(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long, weight double"), 3)
    assert sorted(map(tuple, weighted_distances(g, g.nodes).collect())) == [(0, 0, 0.0), (1, 1, 0.0), (2, 2, 0.0)]
    assert weighted_distances(g, g.nodes.limit(0)).count() == 0

"""Lanczos and tall QR against dense results."""

import numpy as np
import pytest

from lantern.functions import coefficients
from lantern.graph import Graph
from lantern.operators import laplacian, roles, spectral


def ring_with_chords(spark, n=14):
    pairs = [(i, (i + 1) % n) for i in range(n)] + [(0, 5), (2, 9)]
    e = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in pairs], "src long, dst long, weight double")
    g = Graph.from_edges(e, n, directed=False)
    return g, laplacian.symmetric(g, isolated=True)


def dense(matrix, n):
    out = np.zeros((n, n))
    for r in matrix.collect():
        out[r["row"], r["col"]] += r["value"]
    return out


def test_heat_without_a_cut_series(spark):
    g, lap = ring_with_chords(spark)
    values, vectors = np.linalg.eigh(dense(lap, 14))
    got = np.zeros((2, 14))
    for r in spectral.heat_of(lap, g.nodes, 3, [0.7, 25.0], steps=14).collect():
        got[r.tau, r.node] = r.psi
    for i, t in enumerate([0.7, 25.0]):
        assert np.allclose(got[i], (vectors @ np.diag(np.exp(-t * values)) @ vectors.T)[:, 3], atol=1e-10)


def test_ends_of_the_spectrum_and_a_closed_space(spark):
    g, lap = ring_with_chords(spark)
    values = np.linalg.eigvalsh(dense(lap, 14))
    found = spectral.ends(lap, g.nodes, 14)
    assert [v for v, _ in found] == pytest.approx(values, abs=1e-8)
    assert spectral.smallest(lap, g.nodes, 14) == pytest.approx(values[1], abs=1e-8)
    early = spectral.ends(lap, g.nodes, 7)
    assert all(min(abs(values - v)) <= bound + 1e-9 for v, bound in early)
    two = spark.createDataFrame([(0, 0, 2.0), (1, 1, 2.0), (2, 2, 5.0)], "row long, col long, value double")
    k = spectral.lanczos(two, spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "node long, x double"), 3)
    assert len(k.diagonal) == 2 and k.left == 0 and k.pairs()[0] == pytest.approx([2, 5])
    with pytest.raises(ValueError):
        spectral.lanczos(two, spark.createDataFrame([(0, 0.0)], "node long, x double"), 3)


def test_scales_by_the_smallest_eigenvalue():
    assert coefficients.legacy_scales(50) == pytest.approx(coefficients.legacy_scales(7, 1 / 50))


def test_triangle_of_a_tall_table(spark):
    x = np.random.default_rng(1).normal(size=(500, 6))
    x[:, 3] = x[:, 0] - x[:, 1]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(40)
    r = spectral.triangle(df, 6)
    assert np.allclose(np.tril(r, -1), 0) and np.allclose(r.T @ r, x.T @ x)
    assert np.allclose(spectral.triangle(df.limit(0), 6), 0)


def test_columns_that_differ_by_little_are_kept(spark):
    """Products of columns would lose a part of 1e-9 of a column's size."""
    x = np.random.default_rng(2).normal(size=(60, 2))
    x = np.column_stack([x, x[:, 0] + 1e-9 * x[:, 1] ** 2, x[:, 0] + x[:, 1], np.zeros(60)])
    df = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(5) if x[i, j]], "node long, col int, value double")
    assert roles.kept_columns(df, 5, 1e-12) == [True, True, True, False, False]
    assert roles.kept_columns(df, 5, 1e-6) == [True, True, False, False, False]

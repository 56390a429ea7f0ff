"""Outlier scores against their definition and a condensed tree built one link at a time."""

import math

import numpy as np
import pytest

from lantern.operators import density


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>").repartition(3)


def reaches(x, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min(m, len(x) - 1)]
    return np.maximum(d, np.maximum(core[:, None], core)), core


def condensed(x, m):
    """(core, score) by the book: single linkage, clusters of m rows or more condensed, each
    row's distance of leaving its cluster, and the smallest in the cluster or one under it."""
    n = len(x)
    w, core = reaches(x, m)
    a, b = np.triu_indices(n, 1)
    order = np.argsort(w[a, b], kind="stable")
    root, rows, tree = list(range(n)), {i: [i] for i in range(n)}, {}
    children = {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    top = n
    for e in order:
        i, j = find(a[e]), find(b[e])
        if i != j:
            root.append(top)
            root[i] = root[j] = top
            rows[top], children[top] = rows[i] + rows[j], (i, j, w[a[e], b[e]])
            top += 1
    left, under, parent = {}, {}, {}
    stack = [(top - 1, 0)]
    clusters = 1
    while stack:
        node, cluster = stack.pop()
        if node < n:
            continue
        i, j, at = children[node]
        big = [c for c in (i, j) if len(rows[c]) >= m]
        for c in (i, j):
            if c not in big:
                for y in rows[c]:
                    left[y] = (cluster, at)
        for c in big:
            if len(big) == 2:
                parent[clusters] = cluster
                stack.append((c, clusters))
                clusters += 1
            else:
                stack.append((c, cluster))
    least = {c: min([at for k, at in left.values() if k == c], default=math.inf) for c in range(clusters)}
    for c in reversed(range(1, clusters)):
        least[parent[c]] = min(least[parent[c]], least[c])
    return core, np.array([1 - least[left[y][0]] / left[y][1] if left[y][1] > 0 else 0.0 for y in range(n)])


def by_definition(x, m):
    """(eps, score) from the smallest largest reach on a way between any two rows."""
    way, _ = reaches(x, m)
    np.fill_diagonal(way, 0)
    for z in range(len(x)):
        way = np.minimum(way, np.maximum(way[:, z, None], way[z]))
    eps = np.sort(way, axis=1)[:, m - 1]
    least = np.where(way <= eps[:, None], eps, np.inf).min(axis=1)
    return eps, np.where(eps > 0, 1 - least / np.where(eps > 0, eps, 1), 0.0)


def kinds_of_rows():
    r = np.random.default_rng(8)
    blobs = np.concatenate([r.normal(size=(60, 3)) + 30 * r.normal(size=3) for _ in range(4)] + [r.uniform(-60, 60, (20, 3))])
    hot = np.concatenate([blobs[:150], np.tile(blobs[7], (80, 1))])  # a third of all rows are one
    return {"blobs": blobs, "hot": hot, "nested": np.exp(r.normal(size=(150, 1)) * 2), "flat": np.ones((40, 2))}


@pytest.mark.parametrize("kind", ["blobs", "hot", "nested", "flat"])
def test_scores_by_definition_and_by_the_condensed_tree(spark, kind):
    x = kinds_of_rows()[kind]
    got = sorted(density.outlier_scores(frame(spark, x), 5, part_rows=40).collect())
    core, tree = condensed(x, 5)
    eps, score = by_definition(x, 5)
    assert [g["node"] for g in got] == list(range(len(x)))
    assert np.allclose([g["core"] for g in got], core)
    assert np.allclose([g["eps"] for g in got], eps)
    mine = np.array([g["score"] for g in got])
    assert np.allclose(mine, score, atol=1e-9)
    # A tree built link by link gives a row that enters two clusters by equal reaches to one.
    assert (mine >= tree - 1e-9).all() and (np.abs(mine - tree) < 1e-9).mean() > 0.9


def test_few_rows_and_none(spark):
    assert density.outlier_scores(frame(spark, np.zeros((0, 2)))).count() == 0
    got = density.outlier_scores(frame(spark, np.arange(3.0)[:, None]), 5).collect()
    assert sorted((g["node"], g["core"], g["eps"], g["score"]) for g in got) == [(0, 2.0, None, 0.0), (1, 1.0, None, 0.0), (2, 2.0, None, 0.0)]
    assert density.outlier_scores(frame(spark, np.ones((1, 2))), 5).first()["score"] == 0.0

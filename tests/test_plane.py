"""The plane by neighbours: its graph and one round against brute force, its layout by trust."""

import math

import numpy as np
import pytest

from lantern.operators import plane
from lantern.operators.evaluate import principal


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>").repartition(3)


def weights(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    w = np.zeros_like(d)
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:k]
        own = d[i][order]
        first = own[own > 0].min() if (own > 0).any() else 0.0
        beyond, goal = np.maximum(own - first, 0), math.log2(len(order))
        low, high = 0.0, 1e6
        for _ in range(300):
            mid = (low + high) / 2
            with np.errstate(all="ignore"):
                got = np.where(beyond > 0, np.exp(-beyond / mid), 1.0).sum() if mid else (beyond == 0).sum()
            low, high = (mid, high) if got < goal else (low, mid)
        s = max(high, own.mean() * plane.LEAST_WIDTH)
        w[i][order] = np.where(beyond > 0, np.exp(-beyond / s) if s else 0, 1.0)
    return w + w.T - w * w.T


@pytest.mark.parametrize("case", ["spread", "copies", "few"])
def test_fuzzy_graph(spark, case):
    rng = np.random.default_rng(3)
    x = {"spread": rng.normal(size=(60, 4)), "copies": np.repeat(rng.normal(size=(9, 3)), 5, axis=0), "few": rng.normal(size=(4, 2))}[case]
    want = weights(x, 6)
    got = {(r["node"], r["other"]): r["weight"] for r in plane.fuzzy(frame(spark, x), 6, pivots=5, part_rows=20).collect()}
    assert set(got) == {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if want[i, j] > 0}
    for (i, j), w in got.items():
        assert w == pytest.approx(want[i, j], rel=1e-6)


def test_curve():
    a, b = plane.curve(0.1)
    assert a == pytest.approx(1.577, abs=2e-3) and b == pytest.approx(0.895, abs=2e-3)


def test_one_round(spark):
    """A round against sums over all pairs, whom rows are pushed off read from the hash."""
    rng = np.random.default_rng(5)
    n, a, b, rounds, seed = 12, 1.5, 0.9, 8, 4
    p, w = rng.normal(size=(n, 2)), np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.4), 1)
    at_round = 3
    state = spark.createDataFrame([(i, 100 + i, *v.tolist(), at_round) for i, v in enumerate(p)], "at long, node long, x double, y double, round int")
    links = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "a long, b long, weight double")
    shifts = [spark.range(1).selectExpr(f"pmod(xxhash64({at_round}, {t}, {seed}), {n - 1}) + 1 AS s").first()["s"] for t in range(2)]
    s = w + w.T
    want = p.copy()
    for i in range(n):
        force, stiff, push = np.zeros(2), 0.0, np.zeros(2)
        for j in np.flatnonzero(s[i]):
            d2 = ((p[j] - p[i]) ** 2).sum()
            c = s[i, j] * 2 * a * b * d2 ** (b - 1) / (1 + a * d2**b)
            force, stiff = force + c * (p[j] - p[i]), stiff + c
        for t in shifts:
            o = p[(i + t) % n]
            d2 = ((o - p[i]) ** 2).sum()
            push += np.clip(-2 * b / ((0.001 + d2) * (1 + a * d2**b)) * (o - p[i]), -plane.PUSH, plane.PUSH)
        if stiff:
            want[i] += (1 - at_round / rounds) * np.clip((force + s[i].sum() * push / 2) / stiff, -plane.PUSH, plane.PUSH)
    got = plane.moved(state, links, n, rounds, 2, a, b, seed).orderBy("at").collect()
    assert [r["node"] for r in got] == [100 + i for i in range(n)] and {r["round"] for r in got} == {at_round + 1}
    assert np.allclose([[r["x"], r["y"]] for r in got], want, atol=1e-9)


def trust(x, p, k):
    d, e = (((y[:, None] - y[None]) ** 2).sum(axis=2) for y in (x, p))
    out = []
    for i in range(len(x)):
        order = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i]
        near = [j for j in np.lexsort((np.arange(len(x)), e[i])) if j != i][:k]
        out.append(sum(max(0, order.index(j) + 1 - k) for j in near))
    return out


def test_layout_can_be_trusted(spark):
    """Clusters whose centres no plane holds apart: neighbours stay together, more than in
    principal components, and reruns agree."""
    rng = np.random.default_rng(7)
    x = np.concatenate([c + rng.normal(size=(20, 12)) for c in 6 * np.eye(12)[:7]])
    rows = frame(spark, x)
    got = plane.plane(rows, 10, rounds=25).selectExpr("node", "array(x, y) AS features")
    places = np.array([r["features"] for r in got.orderBy("node").collect()])
    assert places.shape == (140, 2) and np.isfinite(places).all()
    ours = plane.trustworthiness(rows, got, rows, 10, block=60).orderBy("query").collect()
    assert [r["penalty"] for r in ours] == trust(x, places, 10)
    flat = plane.trustworthiness(rows, principal(rows), rows, 10)
    mean = np.mean([r["trust"] for r in ours])
    assert mean > 0.93 and mean > np.mean([r["trust"] for r in flat.collect()]) + 0.05


def test_odd_tables(spark):
    assert plane.plane(frame(spark, np.zeros((1, 3))), rounds=2).collect() == [(0, 0.0, 0.0)]
    assert plane.plane(frame(spark, np.zeros((2, 3))).limit(0), rounds=2).count() == 0
    same = plane.plane(frame(spark, np.ones((6, 3))), 3, rounds=2).collect()
    assert len(same) == 6 and all(np.isfinite([r["x"], r["y"]]).all() for r in same)
    assert plane.plane(frame(spark, np.arange(8.0)[:, None]), 3, rounds=2).count() == 8


def test_overview(spark):
    from lantern.graph import Graph

    rng = np.random.default_rng(11)
    x = rng.normal(size=(24, 3))
    x[5] = 40.0
    e = spark.createDataFrame([(i, (i + 1) % 20) for i in range(20)] + [(3, 9)], "src long, dst long")
    got = {r["node"]: r for r in plane.overview(frame(spark, x), Graph.from_edges(e, 24), k=4, m=4, rounds=2).collect()}
    assert set(got) == set(range(24)) and got[3]["degree"] == 3 and got[22]["degree"] == 0
    assert got[5]["outlier_score"] > max(r["outlier_score"] for n, r in got.items() if n != 5)

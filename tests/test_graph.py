"""Canonical graphs, degrees, thresholds, laplacians, paths and features on small fixtures."""

import math

import pytest

from lantern.graph import Graph, adjacency, from_adjacency, reindex
from lantern.operators import degrees, heat, laplacian, paths, roles, synthetic

TAIL = [(0, 1, 2.0), (1, 0, 1.0), (1, 1, 6.0), (1, 2, 3.0), (2, 3, 1.0), (3, 2, 1.0), (3, 4, 5.0), (1, 4, 0.5)]
FIVE = [(0, 1), (0, 2), (0, 3), (1, 2), (2, 1), (2, 3), (3, 4), (2, 4), (1, 4), (4, 3), (4, 2), (4, 1)]


def rows(df):
    return sorted(map(tuple, df.collect()))


def graph(spark, edges, n, **kw):
    columns = "src long, dst long" + (", weight double" if len(edges[0]) > 2 else "")
    return Graph.from_edges(spark.createDataFrame(edges, columns), n, **kw)


def test_duplicates_loops_and_directions(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (1, 0, 5.0), (2, 2, 9.0)], "src long, dst long, weight double")
    assert rows(Graph.from_edges(e, 3).edges) == [(0, 1, 3.0), (1, 0, 5.0)]
    assert rows(Graph.from_edges(e, 3, weighted=False).edges) == [(0, 1, 2.0), (1, 0, 1.0)]
    assert rows(Graph.from_edges(e, 3, directed=False).edges) == [(0, 1, 5.0), (1, 0, 5.0)]
    assert rows(Graph.from_edges(e, 3, directed=False, combine="mean").edges) == [(0, 1, 4.0), (1, 0, 4.0)]
    assert Graph.from_edges(e, 3).nodes.count() == 3
    assert rows(from_adjacency(adjacency(Graph.from_edges(e, 3).edges))) == [(0, 1, 3.0), (1, 0, 5.0)]


def test_reindex_is_dense_and_ordered(spark):
    got = rows(reindex(spark.createDataFrame([("c",), ("a",), ("b",), ("a",), (None,)], "x string"), "x"))
    assert got == [("a", 0), ("b", 1), ("c", 2)]


def test_betas_and_thetas_of_the_tail(spark):
    g = graph(spark, TAIL, 6)
    assert [r[2] for r in rows(degrees.betas(g))] == pytest.approx([2, 4 / 3, 2, 5 / 3, 7 / 4, 7 / 4])
    for r in (0, 1, 3):
        theta = {i: t for i, t in rows(degrees.thetas(g, r))}
        beta = {i: (n, b) for i, n, b in rows(degrees.betas(g))}
        for i in theta:
            n, b = beta[i]
            want = 1e-6
            if r:
                logs = [-r] + ([-r + math.log(r) - math.log(n), -1 - math.log(n) - (r - 1) * math.log(b) - math.lgamma(r + 1)] if n else [])
                want = max(math.exp(min(logs)), 1e-6)
            assert theta[i] == pytest.approx(want)


def test_heat_of_the_tail(spark):
    g = graph(spark, TAIL, 6)
    psi = {r["node"]: r["psi"] for r in heat.heat_kernel(g, [1.0], 40, g.nodes.filter("id = 1")).collect()}
    want = [0.084812622, 0.409517518, 0.261383845, 0.126639569, 0.117646446, 0]
    assert [psi.get(i, 0.0) for i in range(6)] == pytest.approx(want, abs=1e-8)
    assert sum(psi.values()) == pytest.approx(1)


def test_walk_is_identity_less_laplacian(spark):
    g = graph(spark, TAIL, 6)
    lap = {(r, c): v for r, c, v in rows(laplacian.random_walk(g))}
    walk = {(d, s): p for s, d, p in rows(laplacian.walk(g))}
    for i in range(6):
        for j in range(6):
            assert (i == j) - lap.get((i, j), 0.0) == pytest.approx(walk.get((i, j), 0.0))


def test_star_embedding(spark):
    e = synthetic.star(spark, 2, 2, 2)
    g = Graph.from_edges(e, synthetic.star_size(2, 2, 2))
    p = heat.Parameters(size=16, radius=3, order=40, log=False)
    assert (p.n_tau, p.n_points) == (2, 4)
    got = {(n, c): v for n, c, v in rows(heat.embed(g, heat.Parameters(size=16, radius=3, order=40, log=False)))}
    assert [got[0, c] for c in range(4)] == pytest.approx([0.856098, 0.404536, 0.541727, 0.597316], abs=1e-6)
    assert [got[3, c] for c in range(4)] == pytest.approx([0.714286, 0, 1, 0], abs=1e-6)
    assert [got[1, c] for c in range(16)] == pytest.approx([got[2, c] for c in range(16)])


def test_parameters():
    for size, want in {32: (1, 4), 64: (2, 4), 128: (2, 8), 256: (3, 10), 512: (4, 16)}.items():
        p = heat.Parameters(size=size, radius=5, transpose=True, aggregate=True)
        assert (p.n_tau, p.n_points) == want
    with pytest.raises(ValueError):
        heat.Parameters(size=1)


def test_egonets_of_five(spark):
    g = graph(spark, FIVE, 5)
    assert [r[1:] for r in rows(roles.egonet_features(g))] == [(6, 3, 3), (8, 3, 1), (12, 0, 0), (7, 3, 2), (9, 0, 3)]
    assert [r[1:3] for r in rows(degrees.degrees(g))] == [(3, 0), (2, 3), (3, 3), (1, 3), (3, 3)]


def test_neighbour_mean(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 2), (3, 1)], 5)
    f = spark.createDataFrame([(i, c, float(v)) for i, x in enumerate([(1, 0), (-1, -1), (2, 2), (0, 0), (0, 0)]) for c, v in enumerate(x)], "node long, col int, value double")
    got = [v for _, _, v in rows(heat.neighbour_mean(g, f))]
    assert got == pytest.approx([-1, -1, 1, 2 / 3, -0.5, -0.5, 0.5, 0.5, 0, 0])


def test_cycle_distances(spark):
    g = Graph.from_edges(synthetic.cycle(spark, 10), 10)
    got = rows(paths.hops(g, g.nodes.filter("id IN (1, 3)")))
    assert got == sorted((s, t, (t - s) % 10) for s in (1, 3) for t in range(10))
    assert rows(paths.hops(g, g.nodes.filter("id = 0"), depth=2)) == [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    d = rows(paths.weighted_distances(g, g.nodes.filter("id = 0")))
    assert d == [(0, t, float(t)) for t in range(10)]


def test_roles_replay_gives_the_same_columns(spark):
    g = graph(spark, FIVE, 5)
    f, masks = roles.role_features(g, 64)
    again, _ = roles.role_features(g, 64, masks=masks)
    assert [x for r in rows(f) for x in r] == pytest.approx([x for r in rows(again) for x in r])


def brute_egonets(edges, nodes):
    out = []
    for i in nodes:
        own = {i} | {b for a, b in edges if a == i} | {a for a, b in edges if b == i}
        out.append((i, sum(a in own and b in own for a, b in edges), sum(a in own and b not in own for a, b in edges), sum(a not in own and b in own for a, b in edges)))
    return out


def test_egonets_by_triangles(spark):
    import random

    rng = random.Random(0)
    e = {(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(90)) if a != b} | {(0, i) for i in range(1, 25)}
    assert rows(roles.egonet_features(graph(spark, sorted(e), 27))) == brute_egonets(e, range(27))


def test_role_step_of_a_path(spark):
    """A path of three nodes and three isolated ones: means and sums, columns of length 1."""
    g = graph(spark, [(0, 1), (1, 2)], 6)
    f = spark.createDataFrame([(n, c, float(v)) for n, x in enumerate([(1, 0), (-1, -1), (2, 2), (0, 0), (0, 0), (0, 0)]) for c, v in enumerate(x)], "node long, col int, value double")
    want = [[-1, -1, -1, -1], [1.5, 1, 3, 2], [-1, -1, -1, -1], [0] * 4, [0] * 4, [0] * 4]
    size = [math.sqrt(sum(r[c] ** 2 for r in want)) for c in range(4)]
    got = {(n, c): v for n, c, v in rows(roles.neighbour_step(g, f, 2))}
    assert all(got[n, c] == pytest.approx(want[n][c] / size[c]) for n in range(6) for c in range(4))


@pytest.mark.parametrize(("arms", "branch", "depth"), [(1, 5, 3), (5, 2, 2), (3, 3, 3)])
def test_star_normalised_heat_of_stars_is_one(spark, arms, branch, depth):
    g = Graph.from_edges(synthetic.star(spark, arms, branch, depth), synthetic.star_size(arms, branch, depth))
    psi = heat.heat_kernel(g, [1.0], 40, g.nodes.filter("id = 0"))
    got = heat.star_normalised(g, psi, [1.0]).collect()
    if branch == arms or arms == 1 and depth == 1:
        assert [r["psi"] for r in got] == pytest.approx([1.0] * len(got))
    assert len(got) == g.nodes.count() and all(r["psi"] > 0 for r in got)


def test_selected_nodes_have_the_same_embedding(spark):
    g = graph(spark, TAIL, 6)
    p = heat.Parameters(size=32, radius=3, order=20, aggregate=True)
    whole = {(n, c): v for n, c, v in rows(heat.embed(g, p))}
    some = {(n, c): v for n, c, v in rows(heat.embed(g, p, selected=g.nodes.filter("id IN (1, 5)")))}
    assert some == pytest.approx({k: v for k, v in whole.items() if k[0] in (1, 5)}) and len(some) == 64


def test_motifs_and_rings(spark):
    sizes = {m: (len(synthetic.motif(m)[0]), len(synthetic.motif(m, True)[0])) for m in synthetic.MOTIFS}
    assert sizes == {"B5": (47, 47), "C8": (10, 10), "D5": (15, 30), "DB55": (41, 42), "DS5": (21, 22), "H5": (12, 12), "L5": (25, 25), "PB5": (26, 26), "S5": (5, 5), "U5": (15, 15), "W5": (32, 32)}
    e, labels = synthetic.ring_of_motifs(spark)
    assert (e.count(), labels.count()) == (7350, 3240)
    train, test, other = synthetic.split_parts(labels, 5)
    assert (train.count(), test.count(), other.count()) == (1070, 1070, 1100)
    assert synthetic.ring_of_motifs(spark, connectors=2)[0].count() in range(8100, 8231)
    # Nodes of one role can be exchanged: they have the same degrees.
    for m in synthetic.MOTIFS:
        for back in (False, True):
            edges, role = synthetic.motif(m, back)
            deg = [(sum(a == i for a, _ in set(edges)), sum(b == i for _, b in set(edges))) for i in range(len(role))]
            if m not in ("W5", "H5"):
                assert len({(r, d) for r, d in zip(role, deg)}) == len(set(role)), (m, back)
    assert all((b - a) % 20 not in (0, 1, 19) for a, b in synthetic.random_chords(20, 5))


def test_components_against_brute_force(spark):
    import random

    from lantern.operators.components import largest_component, without_isolated
    from lantern.plans.components import components

    rng = random.Random(1)
    e = [(i, i + 1) for i in range(100, 180)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in e:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for a, b in e if a != b for x in (a, b)}
    assert dict(rows(components(spark.createDataFrame(e, "a long, b long")))) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    g = graph(spark, e, 600)
    top = largest_component(g)
    assert top.nodes.count() == 81 and rows(top.edges) == [(i, i + 1, 1.0) for i in range(80)]
    assert without_isolated(g).nodes.count() == len(want)


def test_page_rank_and_leverage(spark):
    import numpy as np

    from lantern.operators import landmarks, ranks

    e = [(0, 1, 2.0), (0, 2, 1.0), (1, 2, 1.0), (2, 0, 3.0), (4, 0, 1.0)]  # 3 is alone, nothing leads to 4
    g = Graph(spark.createDataFrame(e, "src long, dst long, weight double"), spark.range(5))
    a = np.zeros((5, 5))
    for s, t, w in e:
        a[s, t] = w
    p = np.where(a.sum(1, keepdims=True) > 0, a / np.maximum(a.sum(1, keepdims=True), 1), 0.2)
    x = np.full(5, 0.2)
    for _ in range(300):
        x = 0.85 * x @ p + 0.03
    got = {r["node"]: r["rank"] for r in ranks.page_rank(g).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(x.tolist(), abs=1e-5)
    got = {r["node"]: r["score"] for r in ranks.leverage(g).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(np.sqrt((a * a).sum(0)).tolist())
    for how in ("leverage",):
        assert landmarks.landmarks(g, 3, how).count() == 3
    empty = Graph(g.edges.limit(0), g.nodes.limit(0))
    assert ranks.page_rank(empty).count() == 0 and ranks.leverage(empty).count() == 0

"""Sources in turns, ranges of ids by arithmetic, and sketches in slices: the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern import catalog
from lantern.graph import Graph
from lantern.operators import centrality, lanes, paths
from lantern.operators.heat import heat_kernel


def graph(spark, n=40, far=1):
    """far: ids lie so far from one another."""
    r = np.random.default_rng(3)
    pairs = sorted({(int(a) * far, int(b) * far, 1.0) for a, b in r.integers(0, n, (n * 3, 2)) if a != b})
    pairs = sorted(set(pairs) | {(b, a, w) for a, b, w in pairs})
    nodes = spark.range(n).select((F.col("id") * far).alias("id"))
    return Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long, weight double"), nodes)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_of_close_ids_join_nothing(spark):
    """Edges used to be dealt out to a table of nodes for it."""
    edges = spark.range(399).select(F.lit(0).cast("long").alias("_s"), (F.col("id") + 1).alias("dst"))
    close = lanes.placed(edges, lanes.ranges(spark.range(400), 100), "dst")
    assert "Join" not in plan(close) and close.groupBy("part").count().count() == 4
    far = spark.range(400).select((F.col("id") * 1000).alias("id"))
    where = lanes.ranges(far, 100)
    got = lanes.placed(far, where, "id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
    assert len(got) == 4 and sum(r.n for r in got) == 400 and all(x.b < y.a for x, y in zip(got, got[1:]))


def test_supply_moves_its_edges_once(spark):
    """Both directions and the nodes are read from what is written, with nothing dealt out."""
    g, sources = catalog.supply(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in plan(g.edges) and "Exchange" not in plan(g.nodes)
    e = {(r.src, r.dst) for r in g.edges.collect()}
    assert len(e) == g.edges.count() and e == {(b, a) for a, b in e}
    assert {r.id for r in g.nodes.collect()} == {a for a, _ in e}


def test_heat_by_turns_and_ranges(spark, monkeypatch):
    g, sources = graph(spark), spark.range(0, 40, 3)
    get = lambda: {(r.source, r.node): r.psi for r in heat_kernel(g, [1.0], 4, sources).collect()}
    one = get()
    monkeypatch.setattr(lanes, "TURN", 5)
    monkeypatch.setattr(lanes, "RANGE", 16)
    assert lanes.numbering(sources, 16, 1, lanes.TURNS)._turns == 2
    more = get()
    assert one.keys() == more.keys() and all(abs(one[k] - more[k]) < 1e-12 for k in one)


@pytest.mark.parametrize("far", [1, 1000])
def test_hops_send_rows_once_to_a_range(spark, monkeypatch, far):
    """The lists of a node's edges are written, one row for each range they lead to."""
    g = graph(spark, far=far)
    monkeypatch.setattr(lanes, "RANGE", 16)
    seen = []
    real = paths.dealt
    monkeypatch.setattr(paths, "dealt", lambda *a: seen.append(real(*a)) or real(*a))
    got = {(r.source, r.node): r.hops for r in paths.hops(g, g.nodes.filter(F.col("id") % (7 * far) == 0), 2).collect()}
    out = {}
    for r in g.edges.collect():
        out.setdefault(r.src, set()).add(r.dst)
    want = {}
    for s in range(0, 40 * far, 7 * far):
        front, want[s, s] = {s}, 0
        for h in (1, 2):
            front = {b for a in front for b in out.get(a, ()) if (s, b) not in want}
            want |= {(s, b): h for b in front}
    assert got == want and len(seen) == 1


def test_betweenness_by_turns(spark, monkeypatch):
    g, sources = graph(spark), spark.range(0, 40, 4)
    get = lambda: {r.node: r.score for r in centrality.betweenness(g, sources, directed=False).collect()}
    one = get()
    monkeypatch.setattr(lanes, "TURN", 5)
    monkeypatch.setattr(lanes, "RANGE", 16)
    assert get() == pytest.approx(one) and sum(one.values()) > 0


def test_sketches_estimate_and_unite():
    r = np.random.default_rng(1)
    for n in (0, 1, 20, 400, 20_000):
        h = r.integers(0, 1 << 62, (50, n), dtype=np.uint64)
        state = np.zeros((50, 1024), dtype=np.uint8)
        rank = (np.log2(((h >> np.uint64(10)) & (~(h >> np.uint64(10)) + np.uint64(1))).astype(float)) + 1).astype(np.uint8)
        for i in range(50):
            np.maximum.at(state[i], (h[i] & np.uint64(1023)).astype(int), rank[i])
        got = centrality.estimates(state)
        assert abs(got.mean() - n) <= 4 * 1.04 / 32 * n / 7 + 0.1 and (centrality.unpacked(centrality.packed(state), 1024) == state).all()
    at, source = r.integers(0, 7, 500), r.integers(0, 50, 500)
    got, want = np.zeros((7, 1024), dtype=np.uint8), np.zeros((7, 1024), dtype=np.uint8)
    centrality.unite(got, at, state, source)
    np.maximum.at(want, at, state[source])
    assert (got == want).all()


def test_sketches_in_slices(spark, monkeypatch):
    """Two slices of 512 registers err as 1,024 registers do."""
    monkeypatch.setattr(centrality, "SKETCHED", 60)
    monkeypatch.setattr(lanes, "RANGE", 50)
    g = graph(spark, 100)
    got = {r.node: r.score for r in centrality.closeness_estimated(g, 10).collect()}
    want = {r.node: r.score for r in centrality.closeness(g).collect()}
    assert got == pytest.approx(want, rel=4 * 1.04 / 32)

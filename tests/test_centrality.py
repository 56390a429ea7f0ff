"""Betweenness, closeness, landmarks among chosen nodes, noise, star heat far out and time limits."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern import experiments
from lantern.functions import angles
from lantern.graph import Graph
from lantern.operators import centrality, landmarks, lanes, similarity


def graph(spark, pairs, n, both=False):
    pairs = sorted(set(pairs) | ({(b, a) for a, b in pairs} if both else set()))
    return Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double"), n), pairs


def random_pairs(n=60, m=260, seed=2):
    r = np.random.default_rng(seed)
    return [(int(a), int(b)) for a, b in r.integers(0, n, (m, 2)) if a != b]


def slow_paths(pairs, source):
    """Distance and number of shortest paths from source."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    far, count, front = {source: 0}, {source: 1}, [source]
    while front:
        new = {}
        for a in front:
            for b in out.get(a, ()):
                if b not in far:
                    new[b] = new.get(b, 0) + count[a]
        far |= {b: far[front[0]] + 1 for b in new}
        count |= new
        front = list(new)
    return far, count


def slow_betweenness(pairs, n, sources):
    """By pairs: paths through v are paths to v times paths from v on."""
    d = {s: slow_paths(pairs, s) for s in range(n)}
    score = [0.0] * n
    for s in sources:
        far, count = d[s]
        for t, h in far.items():
            for v in far:
                if v not in (s, t) and t != s and t in d[v][0] and far[v] + d[v][0][t] == h:
                    score[v] += count[v] * d[v][1][t] / count[t]
    return score


def values(df):
    return {r.node: r.score for r in df.collect()}


@pytest.mark.parametrize("both", [False, True])
def test_betweenness_by_pairs(spark, monkeypatch, both):
    monkeypatch.setattr(lanes, "NUMBERED", 20)
    g, pairs = graph(spark, random_pairs(), 60, both)
    got = values(centrality.betweenness(g, directed=not both))
    want = slow_betweenness(pairs, 60, range(60))
    assert [got[v] for v in range(60)] == pytest.approx([x / (2 if both else 1) for x in want])


def test_betweenness_of_a_sample_and_of_a_star(spark):
    g, pairs = graph(spark, random_pairs(), 60)
    got = values(centrality.betweenness(g, g.nodes.filter("id % 7 = 0")))
    want = slow_betweenness(pairs, 60, range(0, 60, 7))
    assert [got[v] for v in range(60)] == pytest.approx([x * 60 / 9 for x in want])
    star, _ = graph(spark, [(0, i) for i in range(1, 6)], 7, True)
    assert values(centrality.betweenness(star, normalised=True, directed=False)) == pytest.approx({i: 20 / 30 if i == 0 else 0 for i in range(7)})


def slow_closeness(pairs, n):
    d = [slow_paths([(b, a) for a, b in pairs], v)[0] for v in range(n)]
    return [(len(x) - 1) / sum(x.values()) * (len(x) - 1) / (n - 1) if len(x) > 1 else 0.0 for x in d]


def test_closeness(spark):
    g, pairs = graph(spark, random_pairs(), 60)
    want = slow_closeness(pairs, 60)
    assert [values(centrality.closeness(g))[v] for v in range(60)] == pytest.approx(want)
    assert values(centrality.closeness(g, g.nodes.filter("id IN (3, 59)"))) == pytest.approx({v: want[v] for v in (3, 59)})


def test_closeness_by_sketches_keeps_its_error(spark):
    """Error of 2**10 registers: 1.04 / 32; four times that for none of 400 nodes to miss."""
    pairs = random_pairs(400, 4000, 5)
    g, pairs = graph(spark, pairs, 400)
    got, want = values(centrality.closeness_estimated(g, 10)), slow_closeness(pairs, 400)
    assert all(got[v] == pytest.approx(want[v], rel=4 * 1.04 / 32) for v in range(400))


def test_landmarks_among_chosen_nodes_are_their_best(spark):
    """Whichever join finds the chosen nodes."""
    g, pairs = graph(spark, [(i, j) for i in range(60) for j in range(i)], 60)  # all degrees equal out + in
    g = Graph(g.edges.filter("dst < src - 1 OR src > 30"), g.nodes)
    degree = {i: 0 for i in range(60)}
    for r in g.edges.collect():
        degree[r.src] += 1
        degree[r.dst] += 1
    chosen = list(range(1, 60, 2))
    want = sorted(chosen, key=lambda i: (-degree[i], i))[:5]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("-1", "10485760"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = landmarks.landmarks(g, 5, among=spark.createDataFrame([(i,) for i in chosen], "id long"))
            assert sorted(r.node for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("how", ["betweenness", "closeness", "top betweenness", "top rank"])
def test_landmarks_by_scores(spark, how):
    star, _ = graph(spark, [(0, i) for i in range(1, 9)], 9, True)
    got = {r.node for r in landmarks.landmarks(star, 2, how).collect()}
    assert len(got) == 2
    if how != "closeness":  # the others have next to nothing
        assert 0 in got


def test_star_heat_beyond_the_table(spark):
    rows = spark.createDataFrame([(5,), (170,), (171,), (200,), (1000,)], "n int")
    got = [r.x for r in rows.select(angles.ln_factorial(F.col("n")).alias("x")).collect()]
    assert got == pytest.approx([math.lgamma(n + 1) for n in (5, 170, 171, 200, 1000)], rel=1e-14)
    star = spark.range(1).select(angles.star_log_heat(F.lit(200), F.lit(1), F.lit(1), F.lit(1.0), 3.0).alias("x")).first().x
    assert star == pytest.approx(200 * math.log(3) - 3 - math.lgamma(201))


def test_noise_is_whole_and_the_same_however_dealt(spark):
    g, _ = graph(spark, random_pairs(), 60)
    one = sorted(map(tuple, similarity.noise_edges(g, 60, 3.0, 4).collect()))
    two = sorted(map(tuple, similarity.noise_edges(Graph(g.edges.repartition(5), g.nodes), 60, 3.0, 4).collect()))
    assert one == two and len(one) == 3 * g.edges.count()
    old = {tuple(sorted((r.src, r.dst))) for r in g.edges.collect()}
    assert not old & set(one) and all(a < b for a, b in one)
    free = 60 * 59 // 2 - len(old)
    assert len(similarity.noise_edges(g, 60, free / g.edges.count() + 1e-9).collect()) == free
    with pytest.raises(ValueError):
        similarity.noise_edges(g, 60, free / g.edges.count() + 0.02)


def test_limit_ends_a_run_between_two_jobs(spark):
    def run():
        spark.range(10).count()
        time.sleep(2)  # the limit passes while no job is active
        spark.range(10).count()
        raise AssertionError("a later job ran")

    record, out = experiments.timed(spark, "slow", run, limit=0.8)
    assert record["status"] == "timeout" and out is None
    assert spark.range(5).count() == 5
    record, out = experiments.timed(spark, "quick", lambda: spark.range(3), limit=60)
    assert record["status"] == "completed" and out.count() == 3
    record, out = experiments.timed(spark, "idle", lambda: (time.sleep(1), spark.range(3))[1], limit=0.3)
    assert record["status"] == "timeout" and out is None

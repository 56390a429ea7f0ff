"""Nearest rows, rank correlation, scores, landmarks, alignment and experiments against brute force."""

import math
import random

import numpy as np
import pytest

from lantern import __main__ as command
from lantern import experiments
from lantern.functions import entropies
from lantern.graph import Graph
from lantern.operators import evaluate, landmarks, report, similarity, synthetic


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(230, 6)).round(1)
    x[100] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>")
    got = rows(similarity.nearest(df.filter("node % 9 = 0"), df, 4, part_rows=10).select("query", "rank", "node"))
    want = []
    for q in range(0, 230, 9):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want += [(q, r + 1, int(i)) for r, i in enumerate(np.lexsort((np.arange(230), d))[:4])]
    assert got == want
    assert similarity.nearest(df, df.limit(0), 3).count() == 0


@pytest.mark.parametrize("levels", [3, 40, 100_000])
def test_kendall_by_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 30)
    rng = np.random.default_rng(levels)
    x = rng.integers(0, levels, 400)
    y = np.where(rng.random(400) < 0.4, x, rng.integers(0, levels, 400))
    s = sum(np.sign((x[i] - x[:i]) * (y[i] - y[:i])).sum() for i in range(400))
    ties = lambda z: sum(k * (k - 1) / 2 for k in np.unique(z, return_counts=True)[1])
    n = 400 * 399 / 2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert similarity.kendall_tau(df, "x", "y").first()["tau"] == pytest.approx(s / math.sqrt((n - ties(x)) * (n - ties(y))))
    assert similarity.kendall_tau(df.withColumn("y", df["y"] * 0), "x", "y").first()["tau"] is None


def test_distribution_over_ranges(spark):
    x = spark.createDataFrame([(float(v),) for v in [5, 1, 1, 3, 9, 9, 9, 2]], "v double")
    assert rows(report.cumulative_shares(x, "v")) == [(1.0, 0.25), (2.0, 0.375), (3.0, 0.5), (5.0, 0.625), (9.0, 1.0)]


def test_folds_are_even(spark):
    l = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(103)], "node long, label string")  # noqa: E741
    got = evaluate.folds(l, 3, 5).groupBy("label", "fold").count().collect()
    for name, n in (("a", 77), ("b", 26)):
        assert sorted(r["count"] for r in got if r["label"] == name) == sorted(n // 3 + (i < n % 3) for i in range(3))


def test_adjusted_information(spark):
    """Zero on average for random labels, 1 for equal ones, and the expectation by shuffling."""
    rng = random.Random(0)
    a, b = [rng.randrange(4) for _ in range(60)], [rng.randrange(3) for _ in range(60)]
    df = lambda x, y: spark.createDataFrame(list(zip(x, y)), "label int, pred int")
    assert evaluate.adjusted_information(df(a, a)).first()["ami"] == pytest.approx(1)
    assert abs(evaluate.adjusted_information(df(a, b)).first()["ami"]) < 0.1
    count = lambda x: np.unique(x, return_counts=True)[1]
    def mi(x, y):
        c = np.zeros((4, 3))
        np.add.at(c, (x, y), 1)
        p = c / 60
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nansum(p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0))))
    draws = [mi(np.array(a), np.array(rng.sample(b, 60))) for _ in range(3000)]
    assert evaluate.expected_information(count(a), count(b)) == pytest.approx(np.mean(draws), abs=0.003)


def test_classes_and_clusters_that_lie_apart(spark):
    rng = np.random.default_rng(1)
    x = [(i, (rng.normal(size=2) + [10 * (i % 3), 10 * (i % 3 == 1)]).tolist(), int(i % 3)) for i in range(90)]
    df = spark.createDataFrame(x, "node long, features array<double>, label int")
    p = evaluate.classify(df, 3)
    assert p.count() == 90 and evaluate.class_scores(p).first()["accuracy"] > 0.95
    names = df.selectExpr("node", "concat('c', label) AS label")
    got = evaluate.train_and_predict(df, names.filter("node < 60"), names.filter("node >= 60"))
    assert got.count() == 30 and evaluate.class_scores(got).first()["macro_f1"] > 0.95
    s = evaluate.evaluate_clusters(df).first().asDict()
    assert set(s) == {"fmi", "mi", "nmi", "rand", "ari", "ami", "davies_bouldin", "calinski_harabasz"} and s["ari"] > 0.8 and s["ami"] > 0.8
    assert len(evaluate.principal(df).first()["features"]) == 2


def test_landmark_products_are_the_similarities(spark):
    """With every node a landmark, inner products before scaling give the similarities back."""
    e = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 0), (4, 5), (5, 6), (6, 6)]
    g = Graph.from_edges(spark.createDataFrame(e, "src long, dst long"), 7)
    f = landmarks.directed_features(g)
    c = landmarks.similarities(f, landmarks.landmarks(g, 7))
    w = np.zeros((7, 7))
    for r in c.collect():
        w[r["node"], r["landmark"]] = r["similarity"]
    y = np.array([r["features"] for r in landmarks.embed(g, 7).orderBy("node").collect()])
    size = np.sqrt(np.diag(w))
    assert y @ y.T == pytest.approx(w / np.outer(size, size), abs=1e-6)
    some = landmarks.embed(g, 3, selected=g.nodes.filter("id < 5"))
    assert [r["node"] for r in some.orderBy("node").collect()] == [0, 1, 2, 3, 4]


def test_alignment_of_a_graph_with_itself(spark):
    g = Graph.from_edges(synthetic.cycle(spark, 12, [(0, 4), (2, 9)]), 12)
    other, m = similarity.permuted(g, 5)
    assert sorted(r["new"] for r in m.collect()) == list(range(12)) and other.edges.count() == g.edges.count()
    merged, back = similarity.alignment_maps(12, 12, m.selectExpr("new AS g2_node", "node AS g1_node"))
    assert rows(merged) == [(i, i + 12) for i in range(12)] and back.count() == 12
    with pytest.raises(ValueError):
        similarity.alignment_maps(12, 12, m.selectExpr("new AS g2_node", "0 AS g1_node"))
    noisy, added = similarity.with_noise(g, 12, 0.5, 1)
    assert added == 0.5 and noisy.edges.count() == 21 and noisy.edges.select("src", "dst").distinct().count() == 21
    full = Graph.from_edges(spark.createDataFrame([(a, b) for a in range(4) for b in range(a)], "src long, dst long"), 4)
    with pytest.raises(ValueError):
        similarity.noise_edges(full, 4, 1.0)


def test_heat_differences(spark):
    g = Graph.from_edges(synthetic.cycle(spark, 4), 4)
    heat = lambda v: spark.createDataFrame([(0, i, 0, x) for i, x in enumerate(v)], "source long, node long, tau int, psi double")
    r = similarity.heat_changes(heat([0.5, 0.25, 0.25]), heat([0.4, 0.3, 0.2, 0.1]), g).first()
    u, v = np.array([0, 0.25, 0.25, 0.5]), np.array([0.1, 0.2, 0.3, 0.4])
    assert r["ks"] == pytest.approx(0.1) and r["statistic"] == pytest.approx(0.25)
    assert r["area"] == pytest.approx(sum(0.5 * abs((v[i + 1] + v[i]) / 2 - (u[i + 1] + u[i]) / 2) * (u[i + 1] - u[i] + v[i + 1] - v[i]) for i in range(3)))


def test_entropies(spark):
    m = np.array([[0.5, 0.0, 0.1], [0.25, 1.0, 0.2], [0.25, 0.0, 0.7]])
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(3) if m[i, j]], "row long, col long, value double")
    h = lambda x, e: -x * np.log(x) if x > e else -(x + e) * np.log(x + e)
    assert [v for _, v in rows(entropies.column_entropy(cells, 3))] == pytest.approx([np.mean([h(x, 0.05 / 3) for x in m[:, j]]) for j in range(3)])
    off = [[m[i, j] for i in range(3) if i != j] for j in range(3)]
    assert [r[1] for r in rows(entropies.variance_off_diagonal(cells, 3))] == pytest.approx([np.mean([(x - 1 / 3) ** 2 for x in c]) for c in off])
    assert [r[1] for r in rows(entropies.variance_off_diagonal(cells, 3, True))] == pytest.approx([np.var(c) for c in off])
    want = []
    for j in range(3):
        n, w = np.histogram(m[:, j], bins=4)
        want.append(-np.sum(n * np.log((w[1:] + w[:-1]) / 2)) / 3)
    assert [v for _, v in rows(entropies.histogram_entropy(cells, 3, 4))] == pytest.approx(want)
    assert {(r, c): v for r, c, v in rows(entropies.normalised(cells, "row", "l2"))}[0, 0] == pytest.approx(0.5 / math.hypot(0.5, 0.1))


def test_command_line_and_experiments(spark, tmp_path):
    p = tmp_path / "g.edgelist"
    p.write_text("%6\n0 1\n1 2\n2 0\n2 3\n3 4\n")
    (tmp_path / "nodes.txt").write_text("1\n4\n")
    out = command.main(["heat", "--input", str(p), "--output", str(tmp_path / "h"), "--size", "16", "--nodes", str(tmp_path / "nodes.txt"), "--include-hash"])
    assert out.startswith(str(tmp_path / "h_param")) and [r["node"] for r in spark.read.parquet(out).orderBy("node").collect()] == [1, 4]
    for name in ("degree", "landmark", "recursive"):
        assert spark.read.parquet(command.main([name, "--input", str(p), "--output", str(tmp_path / name), "--size", "4"])).count() == 6
    got = command.main(["recursive", "--input", str(p), "--output", str(tmp_path / "r1"), "--size", "32", "--save-replay", str(tmp_path / "spec.json")])
    again = command.main(["recursive", "--input", str(p), "--output", str(tmp_path / "r2"), "--replay", str(tmp_path / "spec.json")])
    read = lambda x: [r["features"] for r in spark.read.parquet(x).orderBy("node").collect()]
    assert np.array(read(got)) == pytest.approx(np.array(read(again)))

    g = Graph.from_edges(synthetic.cycle(spark, 8, [(0, 3)]), 8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "node long, label int")
    one = experiments.node_classification(spark, g, labels, {"degree": {}}, folds=2, repeats=1)
    assert one[0]["status"] == "completed" and 0 <= one[0]["accuracy"] <= 1 and one[0]["confusion"]
    two = experiments.alignment(spark, g, 8, [0.0], {"degree": {}}, repeats=1, ks=(1, 8))
    assert two[0]["k_8"] == 1.0
    three = experiments.scalability(spark, [20], [2], {"degree": {}}, repeats=1)
    assert [(r["status"], r["n"], r["m"]) for r in three] == [("completed", 20, 2)]
    def slow():
        raise ValueError("no")
    assert experiments.timed(spark, "x", slow)[0]["status"] == "failed"

"""Experiments: embeddings by name, timed runs, and the three evaluations of an embedding."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lantern.graph import Graph, union
from lantern.operators import degrees, evaluate, heat, landmarks, report, roles, similarity, synthetic
from lantern.session import written


def wide(long: DataFrame) -> DataFrame:
    """(node, features array<double>) of (node, col, value)."""
    by_col = F.array_sort(F.collect_list(F.struct("col", "value")))
    return long.groupBy("node").agg(F.transform(by_col, lambda x: x["value"]).alias("features"))


def of_function(ecf: DataFrame) -> DataFrame:
    """(node, features) of (source, tau, t, re, im): re and im by tau and point."""
    parts = F.array_sort(F.collect_list(F.struct("tau", "t", "re", "im")))
    return ecf.groupBy(F.col("source").alias("node")).agg(F.flatten(F.transform(parts, lambda x: F.array(x["re"], x["im"]))).alias("features"))


def heat_graph(g: Graph, size: int, radius: int = 3, order: int = 20, undirected: bool = False, selected: DataFrame | None = None, **kw) -> DataFrame:
    p = heat.Parameters(size=size, radius=radius, order=order, **kw)
    return wide(heat.embed_undirected(g, p, selected) if undirected else heat.embed(g, p, selected=selected))


def wavelets(g: Graph, size: int, order: int = 30, **kw) -> DataFrame:
    return of_function(heat.embed_2018(g, **heat.wavelet_preset(g.nodes.count(), size), order=order))


def magnetic(g: Graph, size: int, order: int = 30, **kw) -> DataFrame:
    return of_function(heat.embed_magnetic(g, **heat.magnetic_preset(size), order=order))


def recursive(g: Graph, size: int, tol: float = 1e-6, weights: bool = False, masks: dict | None = None, **kw) -> DataFrame:
    return wide(roles.role_features(g, size, tol, weights, masks)[0])


def landmark(g: Graph, size: int, undirected: bool = False, alpha: float = 0.1, gamma: float = 1.0, selected: DataFrame | None = None, **kw) -> DataFrame:
    return landmarks.embed(g, size, alpha=alpha, gamma=gamma, directed=not undirected, selected=selected)


def degree(g: Graph, size: int = 2, **kw) -> DataFrame:
    return degrees.degrees(g).select(F.col("id").alias("node"), F.array(F.col("n_out").cast("double"), F.col("n_in").cast("double")).alias("features"))


#: Embeddings by name: (graph, size, options) -> (node, features).
EMBEDDINGS: dict[str, Callable[..., DataFrame]] = {"heat": heat_graph, "wavelets": wavelets, "magnetic": magnetic, "recursive": recursive, "landmark": landmark, "degree": degree}


class OutOfTime(Exception):
    """A run went on beyond its limit."""


def timed(spark: SparkSession, name: str, run: Callable[[], DataFrame], limit: float | None = None) -> tuple[dict, DataFrame | None]:
    """(record, result): the result written, with name, status (completed, timeout, failed or
    oom) and seconds. The run's jobs are one group. Beyond `limit` seconds its active jobs are
    cancelled and all that it starts later, so that a run which is between two jobs then ends at
    the next; one that starts no more is a timeout as well."""
    import threading

    group = f"{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    old = context.getLocalProperty("spark.jobGroup.id")
    context.setJobGroup(group, name, True)
    late = threading.Event()
    def stop():
        late.set()
        context._jsc.sc().cancelJobGroupAndFutureJobs(group)
    alarm = threading.Timer(limit, stop) if limit else None
    if alarm:
        alarm.daemon = True
        alarm.start()
    start, out, status = time.time(), None, "completed"
    try:
        out = written(run(), "embedding")
        if late.is_set():
            raise OutOfTime
    except Exception as e:  # what a run fails of is its result
        out, status = None, "timeout" if late.is_set() else "oom" if "OutOfMemoryError" in str(e) else "failed"
    finally:
        if alarm:
            alarm.cancel()
        context.setLocalProperty("spark.jobGroup.id", old)
    return {"name": name, "status": status, "duration": time.time() - start}, out


def scalability(spark: SparkSession, sizes: list[int], links: list[int], algorithms: dict[str, dict], size: int = 64, repeats: int = 5, limit: float = 8 * 3600.0) -> list[dict]:
    """Records of timed embeddings of preferential-attachment graphs of each size and number
    of links a node; an algorithm is left out after its first run that didn't complete.
    algorithms: options of EMBEDDINGS by name."""
    records, gone = [], set()
    for n in sizes:
        for m in links:
            for r in range(repeats):
                g = Graph.from_edges(synthetic.preferential(spark, n, m, seed=r), n, directed=False)
                for name, options in algorithms.items():
                    if name in gone:
                        continue
                    record, _ = timed(spark, name, lambda: EMBEDDINGS[name](g, size, **options), limit)  # noqa: B023
                    records.append(record | {"n": n, "m": m, "repeat": r})
                    if record["status"] != "completed":
                        gone.add(name)
    return records


def synthetic_quality(spark: SparkSession, connectors: list[int], algorithms: dict[str, dict], size: int = 128, copies: int = 10, samples: int = 5, n_train: int = 5, limit: float = 2000.0) -> list[dict]:
    """Records of class and cluster scores of embeddings of rings of motifs: trained on the
    roles of each motif's first n_train parts, tested on the others."""
    records = []
    for c in connectors:
        for sample in range(samples):
            e, labels = synthetic.ring_of_motifs(spark, copies=copies, connectors=c, seed=sample)
            labels = written(labels, "labels")
            g = Graph.from_edges(e, labels.select("id"))
            train, test, _ = synthetic.split_parts(labels, n_train)
            for name, options in algorithms.items():
                record, got = timed(spark, name, lambda: EMBEDDINGS[name](g, size, **options), limit)  # noqa: B023
                if got is not None:
                    p = evaluate.train_and_predict(got, train, test)
                    record |= evaluate.class_scores(p).first().asDict() | evaluate.evaluate_clusters(got.join(train.unionByName(test), "node", "left")).first().asDict()
                records.append(record | {"connectors": c, "sample": sample})
    return records


def node_classification(spark: SparkSession, g: Graph, labels: DataFrame, algorithms: dict[str, dict], size: int = 128, folds: int = 3, repeats: int = 5, seed: int = 113) -> list[dict]:
    """Records of cross-validated class scores, a record per repeat, and their matrices' cells."""
    records = []
    for name, options in algorithms.items():
        record, got = timed(spark, name, lambda: EMBEDDINGS[name](g, size, **options))  # noqa: B023
        if got is None:
            records.append(record)
            continue
        p = written(evaluate.classify(got.join(labels, "node"), folds, repeats, seed), "predicted")
        for r in range(repeats):
            own = p.filter(F.col("repeat") == r)
            records.append(record | {"repeat": r} | evaluate.class_scores(own).first().asDict() | {"confusion": [x.asDict() for x in report.matrix_mean(evaluate.confusion(own), []).collect()]})
    return records


def alignment(spark: SparkSession, g: Graph, n: int, noise: list[float], algorithms: dict[str, dict], size: int = 128, repeats: int = 5, ks: tuple[int, ...] = (1, 5, 10, 25, 50)) -> list[dict]:
    """Records of top-k accuracies of finding a node's counterpart in a permuted copy with
    noise: queries are the copy's nodes, in blocks, against all of the graph's."""
    records = []
    for share in noise:
        for r in range(repeats):
            noisy, added = similarity.with_noise(g, n, share, seed=r) if share else (g, 0.0)
            other, m = similarity.permuted(noisy, seed=r)
            both = union(g, other, n)
            for name, options in algorithms.items():
                record, got = timed(spark, name, lambda: EMBEDDINGS[name](both, size, **options))  # noqa: B023
                if got is not None:
                    first, second = similarity.split_embedding(got, n)
                    near = similarity.nearest(second, first, max(ks))
                    record |= similarity.top_k_accuracy(near, m.select(F.col("new").alias("query"), "node"), ks).first().asDict()
                records.append(record | {"noise": share, "added": added, "repeat": r})
    return records

"""Tiles of parts and chunks of queries: even tasks, exact results where products of matrices are
in single precision and where they can't be, few rows a query."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lantern.operators import density, neighbours


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, features array<double>").repartition(3)


def bounds_of(x, pivots, k):
    """The index of x by its first rows, and each row's cell."""
    d = np.sqrt(((x[:, None] - x[None, :pivots]) ** 2).sum(axis=2))
    cell, r = d.argmin(axis=1), d.min(axis=1)
    least = np.full((pivots, k), np.inf)
    low, high = np.full(pivots, np.inf), np.full(pivots, -np.inf)
    for c in range(pivots):
        own = np.sort(r[cell == c])
        if len(own):
            least[c, : min(k, len(own))], low[c], high[c] = own[:k], own[0], own[-1]
    part = np.zeros(pivots, dtype=np.int64)
    return neighbours.Bounds(x[:pivots], d[:pivots], low, high, least, part, part + 1, 1e-6 * (np.abs(x).max() + 1)), cell


def tables():
    r = np.random.default_rng(5)
    return {
        "spread": r.normal(size=(900, 64)), "copies": np.concatenate([r.normal(size=(300, 8)), np.tile(r.normal(size=8), (400, 1))]),
        "far": np.concatenate([r.normal(size=(150, 6)) * 1e-3 + c for c in 1e5 * r.normal(size=(4, 6))]), "line": np.arange(3000.0)[:, None] ** 1.5, "offset": r.normal(size=(400, 16)) + 1e7,
    }


@pytest.mark.parametrize("kind", list(tables()))
@pytest.mark.parametrize("bounded", [True, False])
def test_candidates_of_products_hold_the_nearest(kind, bounded):
    x, k = tables()[kind], 9
    b, cell = bounds_of(x, 12, k)
    node = np.random.default_rng(6).permutation(len(x))
    part = neighbours.Nearest(b, node, x, cell, k)
    at = np.arange(0, len(x), 7)
    top = b.visits(x[at], k)[0] if bounded else np.full(len(at), np.inf)
    i, n, d = part.best(x[at], top)
    for q in range(len(at)):
        full = np.sqrt(((x - x[at[q]]) ** 2).sum(axis=1))
        order = np.lexsort((node, full))[:k]
        assert n[i == q].tolist() == node[order].tolist() and d[i == q].tolist() == full[order].tolist()


def test_no_more_than_k_copies_are_compared():
    x = tables()["copies"]
    kept = neighbours.first_copies(x, np.arange(len(x))[::-1], 5)
    assert len(kept) == 305 and sorted(i for i in kept if i >= 300) == list(range(695, 700))


def test_tasks_are_even_and_a_query_brings_k_rows_a_part(spark):
    """By hashes of the part, a task had several parts and others none; few parts, few tasks."""
    x = np.random.default_rng(7).normal(size=(600, 24))
    df = frame(spark, x)
    rows, b = neighbours.index(df, 4, part_rows=100)
    parts = int((b.part + b.parts).max())
    q = df.select(F.col("node").alias("query"), "features").withColumn("own", F.lit(0)).crossJoin(spark.range(parts).select(F.col("id").cast("int").alias("part")))
    make = lambda held: sum(s.num_rows for s in held)
    ask = lambda part, t: pa.RecordBatch.from_arrays([pa.array([part]), pa.array([t.num_rows])], names=["rows", "queries"])
    tiles = neighbours.by_tile(rows.select("node", "features", "cell", "part"), q, parts, "rows long, queries long", make, ask)
    work = [w["work"] for w in tiles.groupBy(F.spark_partition_id()).agg(F.sum(F.col("rows") * F.col("queries")).alias("work")).collect()]
    assert sum(work) == len(x) ** 2
    assert len(work) >= neighbours.TILES and max(work) < 3 * sum(work) / len(work)


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_shortest_reach_to_another_component(spread):
    """One component holds most rows; many rows lie within any bound of an asking one."""
    r = np.random.default_rng(9)
    x = r.normal(size=(700, 32)) + spread * r.integers(0, 3, 700)[:, None]
    component = np.where(r.random(700) < 0.7, 3, r.integers(4, 40, 700))
    core = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 5]
    b, cell = bounds_of(x, 9, 6)
    columns = {"features": pa.array(x.tolist()), "component": pa.array(component), "core": pa.array(core), "cell": pa.array(cell, pa.int32())}
    crowd = density.Crowd(b, [pa.RecordBatch.from_pydict(columns)])
    at = np.arange(0, 700, 3)
    asks = pa.RecordBatch.from_pydict({"features": pa.array(x[at].tolist()), "component": pa.array(component[at]), "core": pa.array(core[at]), "top": pa.array(np.full(len(at), 1e8))})
    got = crowd.nearest(asks).to_pydict()
    reach = np.maximum(np.maximum(np.sqrt(((x[at, None] - x[None]) ** 2).sum(axis=2)), core), core[at, None])
    reach[component[at, None] == component] = np.inf
    want = {int(c): reach[component[at] == c].min() for c in np.unique(component[at])}
    assert dict(zip(got["component"], got["reach"])) == want
    for c, d, other in zip(got["component"], got["reach"], got["other"]):
        assert other != c and (reach[component[at] == c][:, component == other] == d).any()


def test_a_component_passes_over_its_own_rows():
    """Where nearly all rows are one component, its rows are compared with the few others only."""
    r = np.random.default_rng(10)
    x = r.normal(size=(500, 16))
    component = np.where(np.arange(500) < 480, 1, 2)
    b, cell = bounds_of(x, 4, 6)
    crowd = density.Crowd(b, [pa.RecordBatch.from_pydict({"features": pa.array(x.tolist()), "component": pa.array(component), "core": pa.array(np.zeros(500)), "cell": pa.array(cell, pa.int32())})])
    assert sum(e - a for _, kind, a, e, _ in crowd.runs if kind == 0) == 20

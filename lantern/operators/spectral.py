"""Functions and ends of the spectrum of a symmetric matrix, by Lanczos; tall, narrow QR.

The matrix stays in Spark as (row, col, value), and so does the basis: a row a node, with the
node's value in each basis vector so far. A step is one join with the matrix, and two sums over
all nodes: the new vector's products with every earlier one, taken off twice (full
reorthogonalisation), so that the basis stays orthogonal to rounding. What comes to the driver
is the tridiagonal matrix, steps by steps, and `steps` numbers from each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lantern.session import released, written


@dataclass(frozen=True)
class Krylov:
    """diagonal and beside (off-diagonal) of the tridiagonal matrix, the length of the start
    vector, what is left of the last vector (0: the space is closed), and basis (node, v)."""

    diagonal: np.ndarray
    beside: np.ndarray
    length: float
    left: float
    basis: DataFrame

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        t = np.diag(self.diagonal) + np.diag(self.beside, 1) + np.diag(self.beside, -1)
        return np.linalg.eigh(t)


def totals(rows: DataFrame, width: int, taken: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(products of w with the first `width` basis vectors, square of w) over all nodes, w less
    `taken` of each basis vector. rows: (v, w)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width + 1)
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            w = b.column("w").to_numpy(zero_copy_only=False).astype(float)
            w = w if taken is None else w - v @ taken
            sums += np.append(v.T @ w, w @ w)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["s"])

    got = np.array(rows.select("v", "w").mapInArrow(run, "s array<double>").toArrow().column("s").to_pylist())  # a row a task
    whole = got.sum(axis=0) if len(got) else np.zeros(width + 1)
    return whole[:width], float(whole[width])


def lanczos(matrix: DataFrame, start: DataFrame, steps: int, tol: float = 1e-12) -> Krylov:
    """The Krylov space of matrix (row, col, value), symmetric, and start (node, x: a row for
    each node), of `steps` vectors, or fewer where it closes before."""
    length = float(start.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 0.0)
    if not length:
        raise ValueError("the start vector is zero")
    matrix = written(matrix.groupBy("row", "col").agg(F.sum("value").alias("value")), "matrix")
    basis = written(start.select("node", F.array(F.col("x") / length).alias("v")), "basis")
    diagonal, beside, left = [], [], 0.0
    for j in range(1, steps + 1):
        last = basis.select(F.col("node").alias("col"), F.element_at("v", -1).alias("x"))
        w = matrix.join(last, "col").groupBy(F.col("row").alias("node")).agg(F.sum(F.col("value") * F.col("x")).alias("w"))
        both = written(basis.join(w, "node", "left").select("node", "v", F.coalesce("w", F.lit(0.0)).alias("w")), "step")
        first, _ = totals(both, j)
        second, square = totals(both, j, first)
        diagonal.append(float(first[-1] + second[-1]))
        left = float(np.sqrt(max(0.0, square - float(second @ second))))
        scale = max(np.abs(diagonal).max(), max(beside, default=0.0))
        if j == steps or left <= tol * max(scale, 1e-300):
            left = 0.0 if left <= tol * max(scale, 1e-300) else left
            released(both)
            break
        beside.append(left)
        off = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(c)) for c in first + second]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        further = written(both.select("node", F.concat("v", F.array((F.col("w") - off) / left)).alias("v")), "basis")
        released(basis, both)
        basis = further
    released(matrix)
    return Krylov(np.array(diagonal), np.array(beside), length, left, basis)


def combined(k: Krylov, weights: np.ndarray) -> DataFrame:
    """(node, value): the basis vectors' sum by weights."""
    terms = F.zip_with("v", F.array(*[F.lit(float(c)) for c in weights]), lambda a, b: a * b)
    return k.basis.select("node", F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("value"))


def function_of(matrix: DataFrame, nodes: DataFrame, source: int, functions: list, steps: int = 40) -> DataFrame:
    """(node, f, value): functions[f](matrix) e_source; each takes an array of eigenvalues."""
    k = lanczos(matrix, nodes.select(F.col("id").alias("node"), (F.col("id") == source).cast("double").alias("x")), steps)
    values, vectors = k.pairs()
    out = None
    for i, f in enumerate(functions):
        part = combined(k, k.length * (vectors @ (f(values) * vectors[0]))).select("node", F.lit(i).alias("f"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def heat_of(laplacian: DataFrame, nodes: DataFrame, source: int, taus: list[float], steps: int = 40) -> DataFrame:
    """(source, node, tau, psi): exp(-tau L) e_source of a symmetric Laplacian, without any
    series' cut: the error falls faster than exponentially with steps, and is rounding where
    the space closes."""
    values = function_of(laplacian, nodes, source, [lambda x, t=t: np.exp(-t * x) for t in taus], steps)
    return values.select(F.lit(source).cast("long").alias("source"), "node", F.col("f").alias("tau"), F.col("value").alias("psi"))


def ends(matrix: DataFrame, nodes: DataFrame, steps: int = 60, seed: int = 0) -> list[tuple[float, float]]:
    """(eigenvalue, bound of its error) of the space of a start vector drawn by a hash of the
    ids, smallest first; those at both ends settle first. An eigenvalue of several vectors is
    there once."""
    u = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52) - 0.5
    k = lanczos(matrix, nodes.select(F.col("id").alias("node"), u.alias("x")), steps)
    values, vectors = k.pairs()
    return [(float(v), float(k.left * abs(s))) for v, s in zip(values, vectors[-1])]


def smallest(matrix: DataFrame, nodes: DataFrame, steps: int = 60, above: float = 1e-6) -> float:
    """The smallest eigenvalue over `above` (a Laplacian's first is 0)."""
    return min(v for v, _ in ends(matrix, nodes, steps) if v > above)


#: Triangles that one task of a level stacks.
FAN = 16


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """The triangular factor R of rows (x array<double> of `width` values): each task factors its
    rows batch by batch and passes on one triangle; levels of FAN triangles a task stack them
    until one is left. Nothing but that one comes to the driver."""
    def factor(x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(x, mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                s = b.slice(i, 4096)
                r = factor(np.concatenate([r, s.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64()))], names=["x"])

    part = written(rows.select("x").mapInArrow(run, "x array<double>").withColumn("task", F.spark_partition_id()), "triangles")
    while (n := part.select("task").distinct().count()) > 1:
        fewer = part.repartition(-(-n // FAN), "task").select("x").mapInArrow(run, "x array<double>")
        above = written(fewer.withColumn("task", F.spark_partition_id()), "triangles")
        released(part)
        part = above
    r = np.array(part.select("x").toArrow().column("x").to_pylist()).reshape(-1, width)
    released(part)
    return np.triu(factor(np.concatenate([r, np.zeros((width, width))])))

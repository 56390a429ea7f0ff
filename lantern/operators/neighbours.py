"""k nearest rows by a metric partition index.

Pivots, rows of base themselves, cut the space into cells: a row belongs to its nearest pivot.
Of each cell the index knows how near and how far its rows lie from the pivot, and its k
smallest distances. A query's distances to the pivots then bound, by the triangle inequality,

* from above how far its k-th neighbour can be: the k-th smallest of (distance to a pivot, plus
  a distance of a row from that pivot), over all cells;
* from below how near a cell's rows can be: by the cell's radii, and by the plane between the
  cell's pivot and the query's own.

A query goes only to cells whose lower bound reaches its upper one. Cells are packed into parts
of up to part_rows rows, crowded cells cut into several, and queries are dealt into chunks; a
task compares one part with one chunk (a tile), so that tasks are even and about as many as
there is work for, and a query brings k rows from each part and not from each cell. In a tile
the rows come first, and blocks of queries stream past their cells, nearest cells first, each
query's bound falling as it finds nearer rows. Where no bound keeps a query from a cell, as in
many dimensions without clusters, that is a product of all pairs, whose number grows with the
square of the rows: then only its cost per pair counts. Results are exact: products of matrices
(single precision about the cell's pivot, where its error is small beside the bound, else
double) choose candidates with room for their error, and differences give their distances.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lantern.session import written

#: Pivots at most, rows of a part at most and their bytes, and queries that are dealt out at once.
PIVOTS, PART_ROWS, PART_BYTES, QUERY_ROWS = 1024, 80_000, 40 << 20, 128
#: Queries compared at once, rows they are compared with at once, pairs made exact at once.
BLOCK, RUN, EXACT = 512, 2048, 1 << 15
#: Parts at least where they have LEAST_ROWS, and tiles at least.
PARTS, LEAST_ROWS, TILES = 6, 2000, 48


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column as a float64 matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y, by a product of matrices."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


@dataclass(frozen=True)
class Bounds:
    """What each task knows of the index: pivots by cell, their distances from each other,
    smallest and largest distance of a cell's rows (cells without rows: inf, -inf), each cell's
    k smallest ones (inf where there are fewer), first part and number of parts of each cell,
    and the room for rounding."""

    pivots: np.ndarray
    between: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    part: np.ndarray
    parts: np.ndarray
    room: float

    def visits(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(upper bound of each query's k-th distance, whether each goes to each cell)."""
        d = gaps(q, self.pivots)
        top = self.above(d, k)
        return top, (self.floor(d) <= top[:, None]) & (self.high >= self.low)

    def above(self, d: np.ndarray, k: int) -> np.ndarray:
        """Upper bounds of the k-th distances of queries at distances d from the pivots."""
        above = (d[:, :, None] + self.least).reshape(len(d), -1)
        top = np.partition(above, k - 1, axis=1)[:, k - 1] if above.shape[1] >= k else np.full(len(d), np.inf)
        return top + self.room

    def floor(self, d: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """What no row of each cell (of some) is nearer than, by a query's distances d to all
        pivots."""
        own = d.argmin(axis=1)
        least = d[np.arange(len(d)), own][:, None]
        d, apart = d[:, cells], self.between[own][:, cells]
        plane = np.where(apart > 0, (d**2 - least**2) / np.where(apart > 0, 2 * apart, 1), 0)
        room = self.room * (1 + np.where(apart > 0, (d + 1) / np.where(apart > 0, apart, 1), 0))
        return np.maximum(np.maximum(d - self.high[cells], self.low[cells] - d) - self.room, plane - room)

    def of_parts(self, goes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query's row, part): the same once for each part, without its cells."""
        parts = int((self.part + self.parts).max())
        out = np.zeros((len(goes), parts), dtype=bool)
        for c in np.flatnonzero(goes.any(axis=0)):
            out[:, self.part[c] : self.part[c] + self.parts[c]] |= goes[:, c, None]
        return np.nonzero(out)

    def dealt(self, goes: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(query's row, part, cells wanted there) of a table of which query goes to which cell."""
        row, cell = np.nonzero(goes)
        row, cell = np.repeat(row, self.parts[cell]), np.repeat(cell, self.parts[cell])
        new = np.ones(len(row), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])
        at = np.nonzero(new)[0]
        part = self.part[cell] + np.arange(len(row)) - at[np.cumsum(new) - 1]
        order = np.lexsort((cell, part, row))
        row, cell, part = row[order], cell[order], part[order]
        new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
        at = np.nonzero(new)[0]
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(cell, pa.int32()))
        return row[at], pa.array(part[at], pa.int32()), lists


def packed(sizes: np.ndarray, order: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First part and number of parts of each cell: cells in order fill parts together, and
    one of more rows than a part has parts of its own."""
    first, count = np.zeros(len(sizes), dtype=np.int64), np.ones(len(sizes), dtype=np.int64)
    part, held = 0, 0
    for c in order.tolist():
        n = int(sizes[c])
        if held and held + n > part_rows:
            part, held = part + 1, 0
        first[c], count[c] = part, max(1, -(-n // part_rows))
        held += n
        if count[c] > 1:
            part, held = part + int(count[c]), 0
    return first, count


def index(base: DataFrame, k: int, pivots: int | None = None, part_rows: int = PART_ROWS) -> tuple[DataFrame, Bounds] | None:
    """((node, features, cell, r, part), Bounds) of base (node, features); None if it is empty."""
    spark = base.sparkSession
    base = written(base.select("node", "features"), "base")
    n = base.count()
    if not n:
        return None
    count = min(pivots or max(1, math.isqrt(n)), PIVOTS)
    marks = rows_of(base.orderBy(F.xxhash64("node"), "node").limit(count).select("features").toArrow().column("features").combine_chunks())
    held = spark.sparkContext.broadcast(marks)  # PIVOTS rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b.column("features"))
            cell = gaps(x, held.value).argmin(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
            r = np.sqrt(((x - held.value[cell]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("features"), pa.array(cell, pa.int32()), pa.array(r)], names=["node", "features", "cell", "r"])

    cells = written(base.mapInArrow(assign, f"{base.schema.simpleString()[7:-1]}, cell int, r double"), "cells")
    near = Window.partitionBy("cell").orderBy("r", "node")
    first = cells.select("cell", "r", F.row_number().over(near).alias("i")).filter(F.col("i") <= k).groupBy("cell").agg(F.sort_array(F.collect_list("r")).alias("least"))
    all_ = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).join(first, "cell").collect()  # PIVOTS rows
    sizes, low, high, least = np.zeros(len(marks), dtype=np.int64), np.full(len(marks), np.inf), np.full(len(marks), -np.inf), np.full((len(marks), k), np.inf)
    for c in all_:
        sizes[c["cell"]], low[c["cell"]], high[c["cell"]] = c["n"], c["low"], c["high"]
        least[c["cell"], : len(c["least"])] = c["least"]
    between = gaps(marks, marks)
    # What rounding can move a distance by, generously.
    room = 1e-6 * float(np.sqrt((marks * marks).sum(axis=1)).max(initial=0) + high.max(initial=0)) + 1e-300
    size = min(part_rows, max(1, PART_BYTES // (8 * max(1, marks.shape[1]))), max(LEAST_ROWS, -(-n // PARTS)))
    part, parts = packed(sizes, np.argsort(between[0], kind="stable"), size)
    places = spark.createDataFrame([(c, int(part[c]), int(parts[c])) for c in range(len(marks))], "cell int, first int, count int")
    dealt = cells.join(F.broadcast(places), "cell")  # PIVOTS rows
    dealt = dealt.select("node", "features", "cell", "r", (F.col("first") + F.pmod(F.xxhash64("node"), "count")).cast("int").alias("part"))
    return dealt, Bounds(marks, between, low, high, least, part, parts, room)


def visits(queries: DataFrame, bounds: Bounds, k: int) -> DataFrame:
    """(query, features, part, top, cells): the parts that each query goes to, with the cells
    it wants there and the bound of its k-th distance."""
    held = queries.sparkSession.sparkContext.broadcast(bounds)
    schema = f"query long, {queries.select('features').schema.simpleString()[7:-1]}, part int, top double, cells array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(i, QUERY_ROWS)
                top, goes = x.visits(rows_of(b.column("features")), k)
                r, part, lists = x.dealt(goes)
                yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(r)), b.column("features").take(pa.array(r)), part, pa.array(top[r]), lists],
                    names=["query", "features", "part", "top", "cells"])

    return queries.select("query", "features").mapInArrow(run, schema)


class Part:
    """The rows of one part in runs: rows of one cell (and of one kind, of which `kind` is the
    number), by `by`, the first of them by the number of the row."""

    def __init__(self, bounds: Bounds, x: np.ndarray, cell: np.ndarray, kind: np.ndarray | None = None, by: np.ndarray | None = None):
        kind, by = np.zeros(len(x), dtype=np.int8) if kind is None else kind, np.zeros(len(x)) if by is None else by
        self.order = np.lexsort((by, kind, cell))
        self.bounds, self.x, cell, kind, self.by = bounds, x[self.order], cell[self.order], kind[self.order], by[self.order]
        y = self.x - bounds.pivots[cell]
        square = (y * y).sum(axis=1)
        # One product with (q - pivot, 1) gives the squared distance less that of q to the pivot.
        self.single = np.concatenate([-2 * y, square[:, None]], axis=1).astype(np.float32)
        cut = np.nonzero(np.append(True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])))[0]
        runs = [(a, min(a + RUN, e)) for c, e in zip(cut.tolist(), [*cut[1:].tolist(), len(x)]) for a in range(c, e, RUN)]
        self.runs = [(int(cell[a]), int(kind[a]), a, b, float(np.sqrt(square[a:b].max()))) for a, b in runs]

    def close(self, q: np.ndarray, limit: np.ndarray, k: int | None = None, kinds: tuple[int, ...] = (0,), changed: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of q, row of the part) of all pairs whose squared distance can be up to the
        query's limit, which may be lowered between two; with k, of at least each one's k nearest
        in a run. changed: what else is held against the limit than squared distances less the
        queries' `size`, of these, some queries, their sizes and a slice of rows. Rows count
        whose `by` is not over the root of the limit."""
        d = gaps(q, self.bounds.pivots)
        own = sorted({r[0] for r in self.runs})
        at = {c: i for i, c in enumerate(own)}
        floor = self.bounds.floor(d, np.array(own))
        mean = d[:, own].mean(axis=0)
        eps = lambda t: (q.shape[1] + 16) * float(np.finfo(t).eps)
        for c, kind, a, b, far in sorted(self.runs, key=lambda r: mean[at[r[0]]]):
            if kind not in kinds:
                continue
            root = np.sqrt(limit)
            who = np.flatnonzero(floor[:, at[c]] <= root)
            if not len(who):
                continue
            b = a + int(np.searchsorted(self.by[a:b], root[who].max() * (1 + 1e-9), side="right"))
            if a == b:
                continue
            y = q[who] - self.bounds.pivots[c]
            size = (y * y).sum(axis=1)
            reach = (np.sqrt(size) + far) ** 2
            if (np.minimum(limit[who], reach) > 1e3 * eps(np.float32) * reach).sum() * 2 > len(who):
                rows, spare, t = self.single[a:b], eps(np.float32) * reach, np.float32
            else:
                z = self.x[a:b] - self.bounds.pivots[c]
                rows, spare, t = np.concatenate([-2 * z, (z * z).sum(axis=1)[:, None]], axis=1), eps(np.float64) * reach, np.float64
            near = np.concatenate([y, np.ones((len(y), 1))], axis=1).astype(t) @ rows.T
            if changed is not None:
                near, spare = changed(near, who, size, slice(a, b)), spare + eps(t) * limit[who]
            ok = near <= (limit[who] + spare - size).astype(t)[:, None]
            if k is not None and b - a > k and np.count_nonzero(ok) > 4 * k * len(who):
                kth = (near.min(axis=1) if k == 1 else np.partition(near, k - 1, axis=1)[:, k - 1]) + 2 * spare
                ok &= near <= kth.astype(t)[:, None] * (1 + np.sign(kth)[:, None].astype(t) * np.finfo(t).eps * 2)
            pairs = np.flatnonzero(ok)
            if len(pairs):
                i, j = np.divmod(pairs, b - a)
                yield who[i], a + j

    def exact(self, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The distances of pairs."""
        out = np.empty(len(i))
        for a in range(0, len(i), EXACT):
            s = slice(a, a + EXACT)
            out[s] = np.sqrt(((self.x[j[s]] - q[i[s]]) ** 2).sum(axis=1))
        return out


def first_copies(x: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Which rows to keep: of rows that are equal, the k first by node. No other one can be
    among the k nearest of anything."""
    mark = (x * np.cos(np.arange(1.0, x.shape[1] + 1))).sum(axis=1)
    order = np.lexsort((node, mark))
    same = np.append(False, (mark[order][1:] == mark[order][:-1]) & (x[order][1:] == x[order][:-1]).all(axis=1))
    at = np.arange(len(x))
    return order[at - np.maximum.accumulate(np.where(same, 0, at)) < k]


class Nearest(Part):
    """A part that is asked for nearest rows."""

    def __init__(self, bounds: Bounds, node: np.ndarray, x: np.ndarray, cell: np.ndarray, k: int):
        keep = first_copies(x, node, k)
        super().__init__(bounds, x[keep], cell[keep])
        self.node, self.k = node[keep][self.order], k

    def best(self, q: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, node, distance): each query's k best rows here, ties by node."""
        limit, k = top**2, self.k
        kept = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        new, count = [], 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j = (np.concatenate(c) for c in zip(*new))
            i, j, d = (np.concatenate(c) for c in zip(kept, (i, j, self.exact(q, i, j))))
            order = np.lexsort((self.node[j], d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            last = rank == k - 1
            limit[i[last]] = np.minimum(limit[i[last]], d[last] ** 2)
            return i[rank < k], j[rank < k], d[rank < k]

        for i, j in self.close(q, limit, k):
            new.append((i, j))
            count += len(i)
            if count > 2 * k * len(q):
                kept, count = settled(), 0
                new.clear()
        if new:
            kept = settled()
        return kept[0], self.node[kept[1]], kept[2]


def by_tile(rows: DataFrame, queries: DataFrame, parts: int, schema: str, make: Callable, ask: Callable, most: int | None = None) -> DataFrame:
    """rows (part, ..) of base, dealt out with queries (query, part, own, ..), own being the
    nearest pivot, by parts and chunks (`most` of them at most) of queries. make: what a part's base rows become, of
    slices of batches; ask: a batch of answers, or None, of that and of up to BLOCK queries."""
    chunks = min(max(-(-TILES // parts), -(-parts // 8)), most or TILES * parts)
    base = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
    tile = (F.col("part") * chunks + F.col("chunk")).cast("int").alias("tile")
    every = base.unionByName(asked, allowMissingColumns=True).select("*", tile).drop("part", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part, wait = None, [], None, []

        def answers() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(wait).combine_chunks().to_batches()
            wait.clear()
            for b in t:
                for i in range(0, b.num_rows, BLOCK):
                    found = ask(part, b.slice(i, BLOCK))
                    if found is not None:
                        yield found

        for b in batches:
            which, query = b.column("tile").to_numpy(), b.column("query").is_valid().to_numpy(zero_copy_only=False)
            cut = np.nonzero(np.append(True, (which[1:] != which[:-1]) | (query[1:] != query[:-1])))[0]
            for a, e in zip(cut, np.append(cut[1:], len(which))):
                if which[a] != now:
                    if wait:
                        yield from answers()
                    now, held, part = which[a], [], None
                s = b.slice(a, e - a)
                if not query[a]:
                    held.append(s)
                    continue
                if part is None:
                    if not held:
                        continue
                    part, held = make(held), []
                wait.append(s)
                if sum(w.num_rows for w in wait) >= 8 * BLOCK:
                    yield from answers()
        if wait:
            yield from answers()

    # A tile is a partition: by hashes, some tasks would get several and others none.
    dealt = every.repartitionById(parts * chunks, "tile").sortWithinPartitions("tile", F.col("query").isNotNull(), "own")
    return dealt.mapInArrow(run, schema)


def of_index(queries: DataFrame, rows: DataFrame, bounds: Bounds, k: int) -> DataFrame:
    """(query, node, distance, rank): the k rows nearest to each of queries (query, features),
    of an index made for that k."""
    held = queries.sparkSession.sparkContext.broadcast(bounds)
    schema = f"query long, {queries.select('features').schema.simpleString()[7:-1]}, part int, top double, own int"

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        for whole in batches:
            for i in range(0, whole.num_rows, QUERY_ROWS):
                b = whole.slice(i, QUERY_ROWS)
                q = rows_of(b.column("features"))
                top, goes = x.visits(q, k)
                r, part = x.of_parts(goes)
                own = gaps(q, x.pivots).argmin(axis=1)
                t = b.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([t.column("query"), t.column("features"), pa.array(part, pa.int32()), pa.array(top[r]), pa.array(own[r], pa.int32())], names=["query", "features", "part", "top", "own"])

    def make(slices: list[pa.RecordBatch]) -> Nearest:
        take = lambda c: np.concatenate([s.column(c).to_numpy() for s in slices])
        return Nearest(held.value, take("node"), np.concatenate([rows_of(s.column("features")) for s in slices]), take("cell"), k)

    def ask(part: Nearest, t: pa.RecordBatch) -> pa.RecordBatch | None:
        i, node, distance = part.best(rows_of(t.column("features")), t.column("top").to_numpy())
        if len(i):
            return pa.RecordBatch.from_arrays([t.column("query").take(pa.array(i)), pa.array(node), pa.array(distance)], names=["query", "node", "distance"])

    asked = queries.select("query", "features").mapInArrow(visit, schema)
    got = by_tile(rows.select("node", "features", "cell", "part"), asked, int((bounds.part + bounds.parts).max()), "query long, node long, distance double", make, ask)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "node"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, base: DataFrame, k: int, pivots: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """(query, node, distance, rank): the k rows of base (node, features) nearest to each of
    queries (node, features), ties by node."""
    cast = lambda df, name: df.select(F.col("node").cast("long").alias(name), F.col("features").cast("array<double>").alias("features"))
    found = index(cast(base, "node"), k, pivots, part_rows)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query long, node long, distance double, rank int")
    return of_index(cast(queries, "query"), *found, k)

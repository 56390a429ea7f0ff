"""Hard-negative mining by blocked dense products.

Anchors are dealt into blocks of bounded size (BLOCK bytes of float64). For each block one job
broadcasts it and multiplies it with every block of candidates, a dense float64 product each:
integer components keep it exact below 2**53.

1. First pass: each task keeps, for each anchor, the best POSITIVES rows of the anchor's label
   by now - a table of constant size, which merges. The tasks' tables merge by anchor.
2. Second pass: for each anchor and positive, each task keeps the best NEGATIVES rows of other
   labels whose score lies in the window [low / high of the positive's score]; they merge as well.

Candidates are read where they are and dealt out in shares of about WORK multiplications, so
that a task's work stays the same as the table grows; a task holds one batch of candidates, the
block and its tables. Nothing but anchors is broadcast, and only a block of them at a time.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no
part; an empty vector scores 0; a shorter vector counts as ended by zeros; rows of one vec_id
count once among an anchor's positives (and once in each window), with the best score of theirs,
and the anchor is the one with the smallest label, then vector; an anchor's own id is never its
positive or negative; ties go to the smaller vec_id; anchors without positives, and windows
without rows (as any below zero), give no rows; scores beyond 2**53 are computed with Python's
integers, and held at the ends of a long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lantern.graph import before, in_order
from lantern.session import table, written

POSITIVES = 5
NEGATIVES = 5
#: Bytes of one block of anchors, on the driver and in each task.
BLOCK = 16 << 20
#: Multiplications of one task.
WORK = 2_000_000_000
#: Products (anchors times candidates) that a task holds at once.
CELLS = 1 << 20
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "label", "embedding").filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(finite)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, one after the other, and where each list begins."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def matrix(column: pa.Array, scale: int, width: int = 0) -> np.ndarray:
    """floor(scale * x) of a list column as float64 rows, shorter ones ended by zeros."""
    values, offsets = lists(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - offsets[:-1][row]] = np.floor(scale * values.astype(np.float64))
    return out


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64; where float64 might round, by Python's integers."""
    width = min(a.shape[1], c.shape[1])
    a, c = a[:, :width], c[:, :width]
    if np.abs(a).max(initial=0) * np.abs(c).max(initial=0) * max(width, 1) < EXACT:
        return (a @ c.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return np.clip(whole(a).dot(whole(c).T), NONE + 1, LAST).astype(np.int64)


class Best:
    """The best k (score, id) of each row by now: higher scores first, then smaller ids; an id
    counts once, with its best score. Mergeable."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), LAST)

    def add(self, row: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        """Takes in (row, score, id) triples, in any number."""
        if not len(row):
            return
        own = np.nonzero(self.score > NONE)
        touched = np.zeros(len(self.score), dtype=bool)
        touched[row] = True
        held = touched[own[0]]
        row = np.concatenate([row, own[0][held]])
        score = np.concatenate([score, self.score[own][held]])
        id = np.concatenate([id, self.id[own][held]])
        order = np.lexsort((-score, id, row))  # an id's best first; the others go
        row, score, id = row[order], score[order], id[order]
        first = np.ones(len(row), dtype=bool)
        first[1:] = (row[1:] != row[:-1]) | (id[1:] != id[:-1])
        row, score, id = row[first], score[first], id[first]
        order = np.lexsort((id, -score, row))
        row, score, id = row[order], score[order], id[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, score, id, place = (x[place < self.k] for x in (row, score, id, place))
        self.score[touched], self.id[touched] = NONE, LAST
        self.score[row, place], self.id[row, place] = score, id


def leading(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the allowed cells that hold one of their row's k best scores, with
    every cell that equals the k-th: ids settle those."""
    s = np.where(allowed, score, NONE)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.nonzero((s >= kth[:, None]) & (s > NONE))
    return np.nonzero(s > NONE)


def slices(batches: Iterator[pa.RecordBatch], anchors: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows that their products with the anchors are CELLS at most."""
    step = max(1, CELLS // max(anchors, 1))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def best_rows(df: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The best k (score, id) of each group, ranked from 1."""
    w = Window.partitionBy(*groups).orderBy(F.desc("score"), "id")
    one = df.groupBy(*groups, "id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, scale: int = 256, low: int = 80, high: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each
    anchor (rows of `anchor`) and positive, the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    rows: vec_id long, label int, embedding array of numbers."""
    spark = rows.sparkSession
    rows = usable(rows)
    first = F.min(F.struct("label", "embedding")).alias("x")
    anchors = rows.filter(anchor).groupBy("vec_id").agg(first).select("vec_id", "x.label", "x.embedding")
    anchors = in_order(anchors, "vec_id")
    ranges = before(anchors, F.count(F.lit(1)))  # a row per range
    anchors = anchors.join(F.broadcast(ranges), "_p").select("vec_id", "label", "embedding", (F.col("before") + F.col("_i")).alias("index"))
    n, width = anchors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    size, total = max(1, block // (8 * max(width, 1))), rows.select("vec_id").count()
    share = spark.sparkContext.broadcast
    found = []
    for begin in range(0, n, size):
        held = anchors.filter((F.col("index") >= begin) & (F.col("index") < begin + size)).orderBy("index").toArrow()
        ids, labels = held.column("vec_id").to_numpy(), held.column("label").to_numpy()
        block_ = share((ids, labels, matrix(held.column("embedding"), scale)))
        tasks = max(1, -(-total * len(ids) * max(width, 1) // WORK))
        dealt = rows.repartition(int(tasks)) if tasks > 1 else rows

        def positive(batches, block_=block_):
            ids, labels, a = block_.value
            best = Best(len(ids), positives)
            for b in slices(batches, len(ids)):
                cid, label, c = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("embedding"), scale)
                for kind in np.intersect1d(labels, label):
                    r, k = np.nonzero(labels == kind)[0], np.nonzero(label == kind)[0]
                    s = products(a[r], c[k])
                    x, y = leading(s, ids[r][:, None] != cid[k][None, :], surely(cid[k], positives))
                    best.add(r[x], s[x, y], cid[k][y])
            x, y = np.nonzero(best.score > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(best.id[x, y]), pa.array(best.score[x, y])], names=["anchor_id", "id", "score"])

        partial = dealt.mapInArrow(positive, "anchor_id long, id long, score long")
        top = written(best_rows(partial, ["anchor_id"], positives), "positives")
        got = top.toArrow()  # `positives` rows an anchor of the block
        at = np.searchsorted(ids, got.column("anchor_id").to_numpy())
        place = got.column("rank").to_numpy() - 1
        scores, names = np.full((len(ids), positives), NONE), np.full((len(ids), positives), LAST)
        scores[at, place], names[at, place] = got.column("score").to_numpy(), got.column("id").to_numpy()
        wanted = share((scores, names))

        def negative(batches, block_=block_, wanted=wanted):
            ids, labels, a = block_.value
            scores, names = wanted.value
            best = Best(len(ids) * positives, negatives)
            # Beyond what a long holds a hundredfold, Python's integers bound the windows.
            bound = np.array([[-(-low * int(s) // 100) if s >= 0 else LAST for s in row] for row in scores], dtype=object).reshape(scores.shape)
            floor = np.clip(bound, NONE, LAST).astype(np.int64)
            ceiling = np.array([[high * int(s) // 100 if s >= 0 else NONE for s in row] for row in scores], dtype=object).reshape(scores.shape)
            ceiling = np.clip(ceiling, NONE, LAST).astype(np.int64)
            for b in slices(batches, len(ids)):
                cid, label, c = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), matrix(b.column("embedding"), scale)
                s = products(a, c)
                other = (labels[:, None] != label[None, :]) & (ids[:, None] != cid[None, :])
                other &= (s >= floor.min(axis=1, initial=LAST)[:, None]) & (s <= ceiling.max(axis=1, initial=NONE)[:, None])
                near = np.nonzero(other.any(axis=0))[0]
                if not len(near):
                    continue
                s, other, cid = s[:, near], other[:, near], cid[near]
                for j in range(positives):
                    x, y = leading(s, other & (s >= floor[:, j, None]) & (s <= ceiling[:, j, None]), surely(cid, negatives))
                    best.add(x * positives + j, s[x, y], cid[y])
            x, y = np.nonzero(best.score > NONE)
            i, j = x // positives, x % positives
            columns = [ids[i], names[i, j], scores[i, j], best.id[x, y], best.score[x, y]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["anchor_id", "positive_id", "positive_score", "id", "score"])

        partial = dealt.mapInArrow(negative, "anchor_id long, positive_id long, positive_score long, id long, score long")
        out = best_rows(partial, ["anchor_id", "positive_id", "positive_score"], negatives)
        found.append(written(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined"))
        block_.destroy()
        wanted.destroy()
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(found[0].schema).parquet(*(x._written for x in found))


def surely(ids: np.ndarray, k: int) -> int:
    """So many leading cells that k different ids are among them: more where ids repeat."""
    if len(ids) < 2:
        return k
    _, count = np.unique(ids, return_counts=True)
    return k * int(count.max())


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", label.cast("int").alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS mine, c.vec_id AS id, c.label AS other, list_inner_product(a.v, c.v)::BIGINT AS score FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE other = mine QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE other <> mine AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

"""Benchmark decontamination with SimHash windows. DataFrame functions only.

A document leaks an item if some window of the document, as many words long as the item
(shorter only at the document's ends), has a weighted similarity of THRESHOLD or more with
it: sum of min over sum of max of the two counts of each 5-word shingle.

1. Places. In such a window at most m of its shingles are not the item's (m follows from
   the threshold and the item's size), so some run of consecutive shingles is all the item's,
   and so is any shingle on a grid as coarse as the shortest such run. Every document's
   grid shingles are looked up among the items' shingles; windows that hold too few of an
   item's to be similar enough are out. Nothing that step 3 would accept is lost here.
2. SimHash. Each window left gets a 60-bit fingerprint of its words. Fingerprints within
   RADIUS bits agree to within 2 bits in one of 6 blocks of 10 bits; items are indexed by
   every value within 2 bits of each of their blocks, so all pairs within the radius meet.
3. The exact similarity verifies the pairs.

Words are runs of letters a-z (any case), digits and non-ASCII characters. Items are looked
for whole, whatever their length.

A join is broadcast only if the smaller side, counted first, has at most BROADCAST_ROWS rows
(items) or BROADCAST_RUNS runs of windows.

Defined results: null and empty texts hold no window; items with fewer than 5 words have no
shingle and are never found; equal items are found each; documents with one doc_id are
reported once per item, with their best window; null ids of documents or items are not
reported; other columns are ignored by find(), kept by clean().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lantern.llm.batches import counted
from lantern.session import table, written

N = 5
THRESHOLD = 0.8
RADIUS, BLOCKS, WIDTH = 17, 6, 10
BROADCAST_ROWS = 200_000
#: Runs of windows (some 40 bytes each) of the documents that are read again; beyond it texts
#: are dealt out.
BROADCAST_RUNS = 400_000
#: Words up to which four lanes of 15 bits (at bits 0, 15, 30 and 45) count them; two lanes
#: of 30 bits count more than an array holds.
SHORT = 1 << 14
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), MARKS), lambda w: w != "")


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def shingles(h: Column, start: Column | int, n: Column, step: Column | int = 1) -> Column:
    """Hashes of the N word hashes from places start, start + step, ... (from 0) of n words."""
    places = F.sequence(F.lit(start), n - N, F.lit(step))
    return F.when(n >= N, F.transform(places, lambda i: F.xxhash64(F.slice(h, i + 1, N)))).otherwise(F.array().cast("array<long>"))


def majorities(h: Column, n: Column, width: int) -> Column:
    """fingerprint() by sums in lanes of width bits, of at most 1 << width - 1 word hashes."""
    lanes = sum(1 << k for k in range(0, 60, width))
    most = (F.lit((1 << width - 1) - 1) - F.floor(n / 2)).cast("long") * F.lit(lanes)
    out = F.lit(0).cast("long")
    for g in range(width):
        total = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, g).bitwiseAND(F.lit(lanes)))  # noqa: B023
        flags = F.shiftrightunsigned((total + most).bitwiseAND(F.lit(lanes << width - 1)), width - 1)
        out = out.bitwiseOR(F.shiftleft(flags, g))
    return out


def fingerprint(h: Column, n: Column) -> Column:
    """60-bit SimHash of n word hashes: bit b is set if it is in more than half of them."""
    return F.when(n <= SHORT, majorities(h, n, 15)).otherwise(majorities(h, n, 30))


def block(f: Column, j: Column) -> Column:
    return F.call_function("shiftrightunsigned", f, j * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two bags of hashes."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    same = F.array_intersect(a, b)
    once = lambda bag: F.size(F.array_distinct(bag)) == F.size(bag)
    # Counting is only needed where a hash is twice in both.
    common = F.when(once(a) | once(b), F.size(same)).otherwise(F.aggregate(same, F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x))))
    return common / (F.size(a) + F.size(b) - common)


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), h (word hashes), sh (shingles), miss: a row for each item that is
    looked for, written."""
    h = hashes(words(F.col("text")))
    whole = benchmark.filter("item_id IS NOT NULL").select("item_id", h.alias("h")).withColumn("n", F.size("h")).filter(F.col("n") >= N)
    s = F.col("n") - N + 1
    return written(whole.withColumn("sh", shingles(F.col("h"), 0, F.col("n"))).withColumn("miss", (s - F.ceil(2 * THRESHOLD / (1 + THRESHOLD) * s - 1e-9)).cast("int")), "items")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, distance, start, n_words: a row for each item that a
    document leaks, with the first of its most similar windows (in words from 0)."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = items(benchmark)
    least = F.ceil(THRESHOLD * (F.col("n") - N + 1) - 1e-9)  # shingles a window must have
    n_rows, n_shingles, step = wanted.agg(F.count(F.lit(1)), F.sum(F.size("sh")), F.min(F.floor(least / (F.col("miss") + 1)))).first()
    step = max(1, int(step or 1))
    index = wanted.select("item_id", "n", F.greatest(F.lit(1), F.floor(least / step) - F.col("miss")).alias("need"), F.explode(F.array_distinct("sh")).alias("sh"))

    h = hashes(words(F.col("text")))
    grid = docs.select("doc_id", h.alias("h")).filter(F.size("h") >= N).select("doc_id", F.posexplode(shingles(F.col("h"), 0, F.size("h"), step)).alias("i", "sh"))
    hits = grid.join(small(index, n_shingles or 0), "sh").select("doc_id", "item_id", "n", "need", (F.col("i") * step).alias("at")).distinct()
    # How many of an item's shingles a window that starts at `start` has on the grid: each
    # counts from one start to another, so running sums over both ends tell.
    ends = F.array(F.struct((F.col("at") - F.col("n") + N).alias("first"), F.lit(1).alias("d")), F.struct((F.col("at") + 1).alias("first"), F.lit(-1).alias("d")))
    changes = hits.withColumn("end", F.explode(ends)).groupBy("doc_id", "item_id", "n", "need", F.col("end.first").alias("first")).agg(F.sum("end.d").alias("d"))
    one = Window.partitionBy("doc_id", "item_id").orderBy("first")
    runs = changes.withColumn("k", F.sum("d").over(one)).withColumn("last", F.lead("first").over(one) - 1).filter("k >= need")
    runs = runs.select("doc_id", F.struct("n", "first", "last").alias("r")).distinct().groupBy("doc_id").agg(F.collect_list("r").alias("runs"))
    runs = written(runs, "runs")
    n_runs = runs.agg(F.sum(F.size("runs"))).first()[0] or 0

    # A document's words are hashed once, and its windows are slices of them.
    first, stop = lambda w: F.greatest(w["start"], F.lit(0)), lambda w: F.least(w["start"] + w["n"], F.size("h"))
    cut = lambda x, w, less=0: F.slice(F.col(x), first(w) + 1, F.greatest(stop(w) - first(w) - less, F.lit(0)))
    starts = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.transform(F.sequence(r["first"], r["last"]), lambda i: F.struct(r["n"].alias("n"), i.alias("start"))))))
    windows = (
        docs.join(F.broadcast(runs) if n_runs <= BROADCAST_RUNS else runs, "doc_id").select("doc_id", h.alias("h"), starts.alias("starts"))
        .withColumn("sh", shingles(F.col("h"), 0, F.size("h")))
        .select("doc_id", F.explode(F.transform("starts", lambda w: F.struct(w["n"].alias("n"), w["start"].alias("start"), cut("h", w).alias("h"), cut("sh", w, N - 1).alias("sh")))).alias("w"))
        .select("doc_id", "w.*").filter(F.size("h") >= N)
    )
    windows = written(windows.withColumn("f", fingerprint(F.col("h"), F.size("h"))).drop("h"), "windows")

    flips = F.array(*[F.lit(x) for x in range(1 << WIDTH) if x.bit_count() <= RADIUS // BLOCKS])
    j = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("j")
    near = wanted.select("item_id", "n", "sh", fingerprint(F.col("h"), F.col("n")).alias("fi"))
    near = written(near, "fingerprints")
    blocks = near.select("item_id", "n", "fi", j).withColumn("flip", F.explode(flips)).select("item_id", "n", "fi", "j", block(F.col("fi"), F.col("j")).bitwiseXOR(F.col("flip")).alias("v"))
    probes = windows.select("doc_id", "n", "start", "f", j).withColumn("v", block(F.col("f"), F.col("j")))
    variants = sum(math.comb(WIDTH, k) for k in range(RADIUS // BLOCKS + 1)) * BLOCKS
    distance = F.bit_count(F.col("f").bitwiseXOR(F.col("fi")))
    pairs = (
        probes.join(small(blocks, (n_rows or 0) * variants), ["n", "j", "v"])
        .withColumn("distance", distance).filter(F.col("distance") <= RADIUS)
        .select("doc_id", "n", "start", "item_id", "distance").distinct()
    )
    checked = (
        pairs.join(windows.select("doc_id", "n", "start", "sh"), ["doc_id", "n", "start"])
        .join(small(near.select("item_id", "n", F.col("sh").alias("wanted")), n_shingles or 0), ["item_id", "n"])
        .withColumn("similarity", similarity(F.col("sh"), F.col("wanted")))
        .filter(F.col("similarity") >= THRESHOLD - 1e-12)
    )
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.greatest("start", F.lit(0)).alias("start"), "distance", (F.size("sh") + N - 1).alias("n_words"))).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.s")).alias("similarity"), "b.distance", F.col("b.start").cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak an item."""
    leaks = written(find(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(counted(leaks), "doc_id", "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


# Every window at every start, without fingerprints.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ds AS (SELECT doc_id, len(w) AS k, unnest(range(0, greatest(len(w) - 4, 0))) AS p, w FROM w),
d AS (SELECT doc_id, k, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] || ' ' || w[p + 5] AS x FROM ds),
bw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, len(w) AS n, unnest(range(0, greatest(len(w) - 4, 0))) AS i, w FROM bw),
b AS (SELECT item_id, n, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] || ' ' || w[i + 5] AS x, count(*) AS c FROM bs GROUP BY ALL),
h AS (SELECT doc_id, item_id, n, k, p, x, c FROM d JOIN b USING (x)),
s AS (SELECT doc_id, item_id, n, k, start, x, c, count(*) AS cd FROM (SELECT *, unnest(range(p - n + 5, p + 1)) AS start FROM h) GROUP BY ALL),
o AS (SELECT doc_id, item_id, greatest(start, 0) AS start, (least(start + n, k) - greatest(start, 0)) AS n_words, n, sum(least(c, cd)) AS o FROM s GROUP BY doc_id, item_id, start, n, k),
q AS (SELECT *, o / (n - 4 + n_words - 4 - o) AS similarity FROM o)
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity FROM q WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, item_id
"""

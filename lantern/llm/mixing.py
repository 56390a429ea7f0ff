"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Every document is a job of its source's queue, as many words long as it has. A source's
documents are shuffled by the MD5 of their id and served in that order, up to three times
over. A job's virtual finish time is the words its source has been served by then, divided
by the source's target. A job that crosses the target is cut there into two. Served in order
of finish time until the budget (the words of the whole corpus) is spent, each source ends at
its target, give or take the words that rounding leaves over.

Running sums never need one task to hold a source: documents are dealt by the first three
digits of their MD5, sums are taken inside a (source, digits) cell, and the cells' totals -
at most 4,096 a source - give the offsets. The cut in the global order is found the same
way: totals of coarse ranges of finish time, then of fine ranges inside the range that
holds the cut, then job by job inside one fine range.

Defined results: null and empty texts have size 0 and are never taken; a null source is a
source of its own, ordered last; equal rows are jobs of their own; rows of one id are
ordered by size; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lantern.session import table, written

PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"
COARSE = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """(k, size) per document -> (k, source_size, target, budget), a row per source.

    Weights 1, 2, 3, repeating, over the sources in order of k. A source's target is
    min(PASSES * its size, level * weight), the level being such that targets add up to all
    sizes: sharing out what capped sources leave, round by round, ends there. With sources
    ordered by cap per weight, the capped ones are a prefix of that order."""
    per = sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), "k")
    up, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    zero = F.lit(0).cast("long")
    s = (
        per.withColumn("w", ((F.row_number().over(Window.orderBy("k")) - 1) % 3 + 1).cast("long"))
        .withColumn("before", F.coalesce(F.sum("source_size").over(up) * PASSES, zero))
        .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up), zero))
        .withColumn("budget", F.sum("source_size").over(whole))
        # Capped while a share by weight of what is left would reach past the cap.
        .withColumn("capped", PASSES * F.col("source_size") * F.col("w_left") < (F.col("budget") - F.col("before")) * F.col("w"))
        .withColumn("at", F.min(F.when(~F.col("capped"), F.struct("before", "w_left"))).over(whole))
    )
    share = ((F.col("budget") - F.col("at.before")) * F.col("w")).cast("double") / F.col("at.w_left").cast("double")
    target = F.when(F.col("capped"), (PASSES * F.col("source_size")).cast("double")).otherwise(share)
    return s.select("k", "source_size", target.alias("target"), "budget")


def parts(p: int) -> list[tuple[Column, Column]]:
    """(size, virtual finish time) of a document's p-th service, cut in two where the source
    reaches its target: words up to there, and words beyond."""
    end = F.col("upto") + p * F.col("source_size")
    goal = F.floor("target")
    before = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - (end - F.col("size"))))
    return [(before, F.least(end, goal).cast("double") / F.col("target")), (F.col("size") - before, end.cast("double") / F.col("target"))]


def ranges(time: Column) -> tuple[Column, Column]:
    """Coarse and fine range of a finish time; times from 4 on share a coarse range."""
    coarse = F.floor(time * COARSE)
    return F.least(coarse, F.lit(4 * COARSE)), F.floor((time * COARSE - coarse) * COARSE)


def cut_range(totals: DataFrame, at: str) -> DataFrame:
    """The first range whose end reaches the budget: (at, base, budget), one row."""
    upto = Window.partitionBy(F.lit(1)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ends = totals.withColumn("end", F.sum("n").over(upto) + F.col("base"))
    return ends.filter("end >= budget").orderBy(at).limit(1).select(at, (F.col("end") - F.col("n")).alias("base"), "budget")


def mix(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the row's other columns: a row for each
    row of docs. size: words a document counts for; by default those of its text."""
    size = words(F.col("text")) if size is None else size
    # A null source sorts last and joins with itself.
    k = F.when(F.col("source").isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col("source")))
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    slim = written(docs.select("doc_id", k.alias("k"), size.alias("size"), h.alias("h"), F.substring(h, 1, 3).alias("cell")), "mix")
    goal = written(targets(slim.select("k", "size")), "targets")
    before = Window.partitionBy("k").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slim.groupBy("k", "cell").agg(F.sum("size").alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
        .join(goal, "k").drop("n")
    )
    cell = Window.partitionBy("k", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        slim.withColumn("upto", F.sum("size").over(cell))
        .withColumn("nth", F.row_number().over(cell))
        .join(offsets, ["k", "cell"])
        .withColumn("upto", F.col("ahead") + F.col("upto"))
        .drop("cell", "ahead")
    )
    placed = written(placed, "placed")
    coarse, fine = ranges(F.col("time"))
    jobs = (
        placed.filter("size > 0")
        .withColumn("job", F.explode(F.array(*[F.struct(F.lit(2 * p + i).alias("pass"), n.alias("words"), t.alias("time")) for p in range(PASSES) for i, (n, t) in enumerate(parts(p))])))
        .select("*", "job.*").drop("job").filter("words > 0")
        .withColumn("coarse", coarse)
        .withColumn("fine", fine)
    )
    totals = jobs.groupBy("coarse").agg(F.sum("words").alias("n"), F.max("budget").alias("budget"), F.lit(0).cast("long").alias("base"))
    first = written(cut_range(totals, "coarse"), "cut")  # one row, as are those below
    inside = jobs.drop("budget").join(F.broadcast(first), "coarse")
    totals = inside.groupBy("fine").agg(F.sum("words").alias("n"), F.max("budget").alias("budget"), F.max("base").alias("base"))
    cut = written(first.select(F.col("coarse").alias("c0")).crossJoin(cut_range(totals, "fine").withColumnRenamed("fine", "f0")), "cut")
    # The one fine range that holds the cut, job by job; the last job is cut short.
    order = Window.partitionBy(F.lit(1)).orderBy("time", "k", "pass", "h", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        jobs.drop("budget").join(F.broadcast(cut), (F.col("coarse") == F.col("c0")) & (F.col("fine") == F.col("f0")))
        .withColumn("start", F.col("base") + F.coalesce(F.sum("words").over(order), F.lit(0).cast("long")))
        .withColumn("got", F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), F.col("budget") - F.col("start"))))
        .groupBy("k", "h", F.coalesce("doc_id", F.lit(0)).alias("d"), "size", "nth").agg(F.sum("got").alias("at_cut"))
    )
    whole = F.lit(0).cast("long")
    for p in range(PASSES):
        for n, t in parts(p):
            c, f = ranges(t)
            whole = whole + F.when((c < F.col("c0")) | ((c == F.col("c0")) & (f < F.col("f0"))), n).otherwise(0)
    return (
        placed.join(F.broadcast(cut.select("c0", "f0")), how="left")
        .withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(F.lit(0).cast("long")))
        .withColumn("d", F.coalesce("doc_id", F.lit(0)))
        .join(last, ["k", "h", "d", "size", "nth"], "left")
        .select("doc_id", "size", "source_size", "target", (F.coalesce("whole", F.lit(0)) + F.coalesce("at_cut", F.lit(0))).cast("long").alias("taken"))
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
per AS (SELECT k, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM d GROUP BY k),
ranked AS (SELECT *, coalesce(sum(source_size) OVER up, 0)::BIGINT * 3 AS before, (sum(w) OVER () - coalesce(sum(w) OVER up, 0))::BIGINT AS w_left,
    (sum(source_size) OVER ())::BIGINT AS budget FROM per
    WINDOW up AS (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT before, w_left FROM ranked WHERE 3 * source_size * w_left >= (budget - before) * w ORDER BY before, w_left LIMIT 1),
goal AS (SELECT k, source_size, budget, CASE WHEN 3 * source_size * r.w_left < (budget - r.before) * w THEN (3 * source_size)::DOUBLE
    ELSE ((budget - level.before) * w)::DOUBLE / level.w_left::DOUBLE END AS target FROM ranked r LEFT JOIN level ON true),
placed AS (SELECT d.*, source_size, target, budget, (sum(size) OVER o)::BIGINT AS upto, row_number() OVER o AS nth FROM d JOIN goal USING (k)
    WINDOW o AS (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ends AS (SELECT *, (upto + pass * source_size)::BIGINT AS fin, floor(target)::BIGINT AS aim FROM placed, range(3) AS p(pass) WHERE size > 0),
halves AS (SELECT *, greatest(0, least(size, aim - (fin - size))) AS pre FROM ends),
jobs AS (SELECT * EXCLUDE (pass), 2 * pass AS pass, pre AS words, least(fin, aim)::DOUBLE / target AS time FROM halves UNION ALL
    SELECT * EXCLUDE (pass), 2 * pass + 1, size - pre, fin::DOUBLE / target FROM halves),
served AS (SELECT *, coalesce(sum(words) OVER (ORDER BY time, k, pass, h, doc_id, size, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM jobs WHERE words > 0),
got AS (SELECT k, h, doc_id, size, nth, sum(greatest(0, least(words, budget - start)))::BIGINT AS taken FROM served GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0)::BIGINT AS taken FROM placed p
LEFT JOIN got g ON p.k = g.k AND p.h = g.h AND p.doc_id IS NOT DISTINCT FROM g.doc_id AND p.size = g.size AND p.nth = g.nth
"""

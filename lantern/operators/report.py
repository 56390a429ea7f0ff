"""Aggregates over result records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lantern.graph import before, in_order


def mean_std(records: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and sample deviation of each value by group, as <value>_mean and <value>_std."""
    return records.groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def best(records: DataFrame, by: list[str], name: str, value: str, std: str, largest: bool = True) -> DataFrame:
    """Per group the best row's name, and the value a deviation away that is as good."""
    order = F.struct(F.col(value) if largest else -F.col(value), F.col(name))
    top = records.groupBy(*by).agg(F.max(F.struct(order.alias("o"), F.col(value).alias("v"), F.col(std).alias("s"), F.col(name).alias("n"))).alias("x"))
    return top.select(*by, F.col("x.n").alias(name), F.col("x.v").alias(value), (F.col("x.v") + (-1 if largest else 1) * F.col("x.s")).alias("threshold"))


def matrix_mean(cells: DataFrame, by: list[str]) -> DataFrame:
    """Mean of each cell (label, pred) over the matrices of a group."""
    return cells.groupBy(*by, "label", "pred").agg(F.avg("n").alias("n"))


def row_shares(cells: DataFrame) -> DataFrame:
    """Each cell's share of its row."""
    return cells.select("label", "pred", (F.col("n") / F.sum("n").over(Window.partitionBy("label"))).alias("share"))


def share_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, pred, share): each cell's share of its row in a less that in b."""
    minus = row_shares(b).select("label", "pred", (-F.col("share")).alias("share"))
    return row_shares(a).unionByName(minus).groupBy("label", "pred").agg(F.sum("share").alias("share"))


def largest_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The largest value of each group."""
    return df.groupBy(*by).agg(F.max(value).alias(value))


def processed(records: DataFrame, names: dict[str, str], name: str = "name", status: str = "status") -> DataFrame:
    """Completed records of the names given, under their new names, in the order of `names`."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    new = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    kept = records.filter(F.col(name).isin(list(names)) & (F.col(status) == "completed"))
    return kept.withColumn("place", place[F.col(name)]).withColumn(name, new[F.col(name)])


def changes(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows whose value differs from that of the row before in the order of column `by`, the
    first one included."""
    d = in_order(df, by)
    ends = d.groupBy("_p").agg(F.max(F.struct("_i", F.struct(value))).alias("e"))
    ends = ends.select("_p", F.lag("e").over(Window.orderBy("_p")).alias("e"))  # a row per range
    last = F.coalesce(F.lag(F.struct(value)).over(Window.partitionBy("_p").orderBy("_i")), F.col("e.col2"))
    return d.join(F.broadcast(ends), "_p").withColumn("last", last).filter(F.col("last").isNull() | ~F.col("last").eqNullSafe(F.struct(value))).select(*df.columns)


def pretty_name(name: Column, parts: dict[str, str]) -> Column:
    """A run's name as a reader wants it: each part between underscores that `parts` knows is
    replaced (by nothing: left out), the others stay; numbers behind a part are kept."""
    word = lambda x: F.regexp_extract(x, "^([A-Za-z]*)", 1)
    known = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
    each = F.transform(F.split(name, "_"), lambda x: F.when(F.map_contains_key(known, word(x)), F.concat(known[word(x)], F.regexp_replace(x, "^[A-Za-z]*", ""))).otherwise(x))
    return F.array_join(F.filter(each, lambda x: x != ""), " ")


def natural_key(text: Column) -> Column:
    """What to order names with numbers in them by: text and numbers in turn."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]+(?:\\.[0-9]+)?|[^0-9]+"), F.lit(0)), lambda x: F.struct(x.try_cast("double").alias("number"), x.alias("text")))


def shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of each value."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"))
    return c.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("t")).alias("share"))  # one row


def cumulative_shares(df: DataFrame, column: str) -> DataFrame:
    """(column, share): the empirical distribution function at its values; the value is a
    number or text, null last among the least. Counts are summed inside ranges of values, and
    the ranges' sums added."""
    d = in_order(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column)
    upto = F.sum("n").over(Window.partitionBy("_p").orderBy("_i"))
    return d.withColumn("upto", upto).join(F.broadcast(before(d, F.sum("n"))), "_p").select(column, ((F.col("before") + F.col("upto")) / F.col("whole")).alias("share"))


def sample_distribution(edf: DataFrame, column: str, draws: DataFrame) -> DataFrame:
    """(draw, value) of draws (draw, u in [0, 1)): the inverse of a distribution function,
    linear between its values."""
    d = in_order(edf.select(F.col(column).cast("double").alias("v"), "share"), "v")
    # The step before a range's first one is the last of the range before it.
    ends = d.groupBy("_p").agg(F.max(F.struct("v", "share")).alias("end"))
    ends = ends.select("_p", F.lag("end").over(Window.orderBy("_p")).alias("end"))  # a row per range
    w = Window.partitionBy("_p").orderBy("_i")
    steps = d.join(F.broadcast(ends), "_p").select("v", "share", F.coalesce(F.lag("share").over(w), "end.share", F.lit(0.0)).alias("low"), F.coalesce(F.lag("v").over(w), "end.v", "v").alias("from"))
    j = draws.join(steps, (F.col("u") >= F.col("low")) & (F.col("u") < F.col("share")))
    return j.select("draw", (F.col("from") + (F.col("v") - F.col("from")) * (F.col("u") - F.col("low")) / (F.col("share") - F.col("low"))).alias("value"))

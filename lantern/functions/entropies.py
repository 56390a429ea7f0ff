"""Entropies and transforms of columns of heat."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def surprise(x: Column, least: float = 1e-6) -> Column:
    """-x ln x; least is added to an x up to it, and a negative x has none."""
    y = F.when(x > least, x).otherwise(x + least)
    return F.when(x >= 0, -y * F.ln(y))


def log_transform(x: Column, base: float | None = None) -> Column:
    """ln of values over 0 (to another base on request), and 0 else."""
    return F.when(x > 0, F.ln(x) / (math.log(base) if base else 1.0)).otherwise(0.0)


def angle(real: Column, imaginary: Column) -> Column:
    """atan of the imaginary over the real part of a characteristic function."""
    return F.atan(imaginary / real)


def histogram_entropy(cells: DataFrame, n: int, bins: int = 20) -> DataFrame:
    """(col, entropy) of (row, col, value), n rows a column, values left out being 0: the mean
    of -ln of the middles of equal bins between the column's smallest and largest value."""
    some = cells.groupBy("col").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("k"))
    some = some.select("col", "k", F.when(F.col("k") < n, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(F.col("k") < n, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    # A column of one value has the range a half to both sides of it.
    one = F.col("lo") == F.col("hi")
    some = some.select("col", "k", F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    def minus_log(value):
        width = (F.col("hi") - F.col("lo")) / bins
        at = F.least(F.floor((value - F.col("lo")) / width), F.lit(bins - 1))
        return -F.ln(F.col("lo") + (at + 0.5) * width)
    x = cells.join(some, "col").groupBy("col").agg(F.sum(minus_log(F.col("value"))).alias("s"), F.max("k").alias("k"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    rest = F.when(F.col("k") < n, (n - F.col("k")) * minus_log(F.lit(0.0))).otherwise(0.0)
    return x.select("col", ((F.col("s") + rest) / n).alias("entropy"))


def variance_off_diagonal(cells: DataFrame, n: int, own_mean: bool = False) -> DataFrame:
    """(col, variance, mean) of (row, col, value) of n rows, without the diagonal: around 1/n,
    or around the mean of the others."""
    off = cells.filter("row <> col").groupBy("col").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    every = cells.select("col").distinct().join(off, "col", "left").na.fill(0.0)
    mean = F.col("s") / (n - 1) if own_mean else F.lit(1.0 / n)
    return every.select("col", (F.col("q") / (n - 1) - 2 * mean * F.col("s") / (n - 1) + mean * mean).alias("variance"), mean.alias("mean"))


def column_entropy(cells: DataFrame, n: int, least: float | None = None) -> DataFrame:
    """(col, entropy): the mean of surprise() over the n rows of each column; least: by default
    a twentieth of 1/n."""
    least = 0.05 / n if least is None else least
    x = cells.groupBy("col").agg(F.sum(surprise(F.col("value"), least)).alias("s"), F.count(F.lit(1)).alias("k"))
    return x.select("col", ((F.col("s") + (n - F.col("k")) * (-least * math.log(least))) / n).alias("entropy"))


def normalised(cells: DataFrame, by: str = "col", norm: str = "l1") -> DataFrame:
    """(row, col, value) with each column (or row) divided by its norm: l1, l2 or max."""
    size = {"l1": F.sum(F.abs("value")), "l2": F.sqrt(F.sum(F.col("value") * F.col("value"))), "max": F.max(F.abs("value"))}[norm]
    s = cells.groupBy(by).agg(size.alias("size"))
    return cells.join(s, by).select("row", "col", F.when(F.col("size") > 0, F.col("value") / F.col("size")).otherwise(0.0).alias("value"))

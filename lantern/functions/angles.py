"""Heat to angle transforms and star heat, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def linear(x: Column, top: float = 1.0, bottom: float = 0.0) -> Column:
    return math.pi * (x - bottom) / (top - bottom)


def log_arctan(x: Column, top: float | None = None, bottom: float = 0.0) -> Column:
    """atan(ln tan(half the linear angle)) + pi/2, or atan(ln x) + pi/2 without a top; 0 for
    0, and x is at most the top."""
    if top is None:
        return F.when(x <= 0, 0.0).when(x == float("inf"), math.pi).otherwise(F.atan(F.ln(x)) + math.pi / 2)
    half = F.least(linear(x, top, bottom) / 2, F.lit(math.pi / 2))
    return F.when(x <= bottom, 0.0).otherwise(F.atan(F.ln(F.tan(half))) + math.pi / 2)


def ln_factorial(n: Column, most: int = 170) -> Column:
    """ln n! for n from 0 on: from a table to `most`, beyond it by Stirling's series, which is
    exact to the last digits there."""
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(most + 1)])
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n > most, series).otherwise(F.element_at(table, F.least(n, F.lit(most)).cast("int") + 1))


def star_log_heat(hops: Column, branch: Column, out_degree: Column, beta: Column, tau: float) -> Column:
    """ln heat at `hops` from the centre of a star with out_degree arms that branch by beta.
    branch: the node's own out-degree; a sink holds what has come that far."""
    b = F.greatest(beta, F.lit(1.0))
    t = F.lit(float(tau))
    before = F.aggregate(F.sequence(F.lit(0), F.greatest(hops.cast("int") - 1, F.lit(0))), F.lit(0.0), lambda s, k: s + F.exp(k * F.ln(t) - t - ln_factorial(k)))
    rim = F.ln(F.greatest(1 - before, F.lit(1e-300)))
    spread = (hops - 1) * F.ln(b) + F.ln(out_degree)
    inner = hops * F.ln(t) - t - ln_factorial(hops)
    return (
        F.when(hops.isNull(), F.lit(float("-inf")))
        .when(hops == 0, F.when(out_degree < 1, 0.0).otherwise(-t))
        .when(out_degree < 1, F.lit(0.0))
        .when(branch < 1, rim - spread)
        .otherwise(inner - spread)
    )

"""Series coefficients and error bounds (numbers, computed where the plan is made)."""

from __future__ import annotations

import math


def poisson(tau: float, order: int) -> list[float]:
    """Weights of a walk's first `order` step counts in exp(-tau L): e^-tau tau^k / k!."""
    return [math.exp(k * math.log(tau) - tau - math.lgamma(k + 1)) if tau > 0 else float(k == 0) for k in range(order)]


def chebyshev(tau: float, order: int, nodes: int = 256) -> list[float]:
    """Coefficients on the Chebyshev polynomials of X = L - 1 of exp(-tau (X + 1)), by
    Gauss quadrature."""
    theta = [math.pi * (j + 0.5) / nodes for j in range(nodes)]
    value = [math.exp(-tau * (math.cos(t) + 1)) for t in theta]
    return [(2 - (k == 0)) / nodes * sum(v * math.cos(k * t) for v, t in zip(value, theta)) for k in range(order)]


def taylor_bound(n: int, order: int, tau: float) -> float:
    """Bound on the 1-norm error of the series cut after `order` powers, rounding included."""
    tail = math.exp(-tau + (order + 1) * math.log(tau) - math.lgamma(order + 2)) / max(1e-300, 1 - tau / (order + 2)) if tau < order + 2 else 1.0
    unit = 2.0**-53
    return tail + 2 * n * order * unit / (1 - n * order * unit)


def rounding(n: int, order: int, unit: float = 2.0**-52) -> float:
    """What rounding adds, relatively, to `order` products with n-row matrices."""
    return n * order * unit / (1 - n * order * unit)


def exponential_bound(n: int, order: int, tau: float, relative: bool = False) -> float:
    """Bound on the 1-norm error of exp(-tau A), A an n-row matrix of norm 1, by its power series
    up to A**order in double precision; relative: to the norm of the exponential."""
    cut = math.exp((order + 1) * math.log(tau) + tau - math.lgamma(order + 2)) if tau > 0 else 0.0
    return (rounding(n, order) + cut) * math.exp(3 * tau if relative else tau)


def power_series(tau: float, order: int) -> list[float]:
    """Coefficients of exp(-tau x) on x**0 .. x**order."""
    out = [1.0]
    for k in range(1, order + 1):
        out.append(out[-1] * -tau / k)
    return out


def chebyshev_on_order(tau: float, order: int) -> list[float]:
    """chebyshev() of order + 1 coefficients by as many nodes as `order` says: the last one is
    0, as the nodes are the zeros of its polynomial."""
    return chebyshev(tau, order + 1, order)


def linspace(a: float, b: float, n: int) -> list[float]:
    return [a] if n == 1 else [a + (b - a) * i / (n - 1) for i in range(n)]


def legacy_scales(n: int, smallest: float | None = None) -> tuple[float, float]:
    """The two scales of an undirected graph of n nodes by its smallest eigenvalue above 0 (see
    lantern.operators.spectral.smallest), or 1/n in its place."""
    root = math.sqrt(0.5 / (smallest or 1 / n))
    return -math.log(0.95) * root, -math.log(0.80) * root

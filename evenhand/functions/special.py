"""Tail probability of the F distribution, of numbers and of columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float, eps: float = 4e-15) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz), to convergence: the
    number of terms grows with the square root of the larger parameter."""
    rounds = 1000 + 20 * int(math.sqrt(max(a, b)))
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, rounds + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < eps:
            return h
    raise ArithmeticError(f"the beta fraction did not converge for a={a}, b={b}, x={x}")


def beta_regularized(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    if f <= 0.0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_regularized(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


# --- the same of columns ------------------------------------------------------------------------

def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: Stirling's series ten steps up, and the recurrence back."""
    z = x + 10.0
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / (z * z)) / (z * z)) / (z * z)) / z
    up = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    back = F.log(x)
    for i in range(1, 10):
        back = back + F.log(x + float(i))
    return up - back


def _fraction_column(a: Column, b: Column, x: Column, eps: float = 4e-15) -> Column:
    """:func:`_beta_fraction` as a fold; null if it does not converge."""
    tiny = 1e-300
    large = lambda v: F.when(F.abs(v) > tiny, v).otherwise(tiny)
    state = lambda c, d, h, done: F.struct(c.alias("c"), d.alias("d"), h.alias("h"), done.alias("done"))
    d0 = 1.0 / large(1.0 - (a + b) * x / (a + 1.0))

    def half(s: Column, term: Column) -> Column:
        d, c = 1.0 / large(1.0 + term * s["d"]), large(1.0 + term / s["c"])
        return state(c, d, s["h"] * c * d, F.abs(c * d - 1.0) < eps)

    def step(s: Column, m: Column) -> Column:
        k = m.cast("double")
        even = k * (b - k) * x / ((a + 2 * k - 1.0) * (a + 2 * k))
        odd = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1.0))
        first = half(s, even)
        return F.when(s["done"], s).otherwise(F.aggregate(F.array(odd), first, half))  # the array binds the first half once

    rounds = F.sequence(F.lit(1), (1000 + 20 * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(rounds, state(F.lit(1.0), d0, d0, F.lit(False)), step, lambda s: F.when(s["done"], s["h"]))


def f_tail_column(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom, as an expression; null for null arguments or no degrees of freedom."""
    f, a, b = f.cast("double"), d2.cast("double") / 2.0, d1.cast("double") / 2.0
    x = 2.0 * a / (2.0 * a + 2.0 * b * f)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    low = x < (a + 1.0) / (a + b + 2.0)
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1.0 - x)
    part = front * _fraction_column(p, q, y) / p
    usable = f.isNotNull() & (a > 0) & (b > 0)
    return F.when(~usable, None).when(f <= 0.0, 1.0).when(f == float("inf"), 0.0).when(front == 0.0, F.when(low, 0.0).otherwise(1.0)).when(low, part).otherwise(1.0 - part)

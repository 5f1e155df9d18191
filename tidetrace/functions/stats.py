"""Aggregate helpers that give the same bits on every engine and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

MICRO = 1_000_000


def exact_mean(c: Column) -> Column:
    """Mean of 6-place values from an exact integer sum of micro-units.

    Integer sums do not depend on summation order, so the result is the same
    double for any partitioning (and equals the SQL form below)."""
    micro = F.round(c * F.lit(MICRO)).cast("decimal(38,0)")
    # decimal(38,0) cannot overflow at any row count; below 2^53 the cast to
    # double is exact, so the result matches an integer-sum / count division.
    return F.try_divide(F.sum(micro).cast("double"), F.count(c)) / F.lit(float(MICRO))


def pct(cond: Column) -> Column:
    """100 · (rows where cond) / rows, from exact counts."""
    return F.try_divide(F.count_if(cond) * F.lit(100), F.count(F.lit(1)))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def pearson_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p-value of Pearson's r under H0: rho = 0 (t with n-2 df).

    Runs on the driver on the one-row result of ``corr``; no data moves."""
    if r is None or n is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1.0 - r * r)
    return incomplete_beta(df / 2.0, 0.5, df / (df + t2))


def _log_gamma_step(z: Column) -> Column:
    """ln gamma(z + 1/2) - ln gamma(z) for z > 0: the asymptotic series at z + 32, carried back."""
    w = z + F.lit(32.0)
    series = (F.log(w) / 2 - 1 / (8 * w) + 1 / (192 * F.pow(w, F.lit(3.0))) - 1 / (640 * F.pow(w, F.lit(5.0)))
              + 17 / (14336 * F.pow(w, F.lit(7.0))))
    back = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0.0),
                       lambda s, i: s + F.log((z + i + F.lit(0.5)) / (z + i)))
    return series - back


def _beta_fraction(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """Continued fraction of the incomplete beta function (modified Lentz), each step unless converged."""
    def safe(v):
        return F.when(F.abs(v) < F.lit(1e-300), F.lit(1e-300)).otherwise(v)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"), F.lit(False).alias("done"))

    def half(s, k):
        d = 1 / safe(1 + k * s["d"])
        c = safe(1 + k / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"),
                        (F.abs(d * c - 1) < F.lit(3e-16)).alias("done"))

    def step(s, i):
        # Odd entries and even ones of the fraction, one after the other.
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(s["done"], s).otherwise(half(s, F.when(i % 2 == 0, even).otherwise(odd)))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps)), start, step, lambda s: s["h"])


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r of n pairs under rho = 0, as a column: the regularised
    incomplete beta function I_x((n - 2) / 2, 1 / 2) at x = 1 - r * r. Null for fewer than 3 pairs."""
    a, b, x = (n.cast("double") - 2) / 2, F.lit(0.5), 1 - r * r
    log_beta = _log_gamma_step(a) - F.lit(math.lgamma(0.5))
    front = F.exp(log_beta + a * F.log(x) + b * F.log(r * r))
    low = front * _beta_fraction(a, b, x) / a
    high = 1 - front * _beta_fraction(b, a, 1 - x) / b
    inside = F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)
    return (F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(None).cast("double")).when(F.abs(r) >= 1, F.lit(0.0))
            .when(r == 0, F.lit(1.0)).otherwise(inside))

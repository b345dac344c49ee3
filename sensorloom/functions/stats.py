"""Column expressions for tails, combinations and forecast scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

MAD_SCALE = 1.4826


def chi2_sf_even(stat: Column, half: Column | int) -> Column:
    """Chi-square survival for 2 * ``half`` degrees of freedom.

    It is the chance of fewer than ``half`` events of a Poisson variable with mean ``stat`` / 2, each term taken in
    logs so that none is 0 times infinity.
    """
    x = stat / 2.0
    half = F.lit(half) if isinstance(half, int) else half
    places = F.sequence(F.lit(0), F.greatest(half, F.lit(1)).cast("int") - 1)
    log_factorial = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0.0), lambda a, j: a + F.when(j > 1, F.log(j.cast("double"))).otherwise(0.0))
    terms = F.transform(places, lambda i: F.exp(i * F.log(x) - x - log_factorial(i)))
    tail = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(x <= 0, 1.0).otherwise(F.least(tail, F.lit(1.0)))


def gpd_sf(x: Column, u: Column, sigma: Column, gamma: Column) -> Column:
    """P(X > x | X > u) under a generalised Pareto tail, exponential as gamma goes to 0."""
    z = F.greatest(x - u, F.lit(0.0))
    base = 1.0 + gamma * z / sigma
    return (
        F.when(F.abs(gamma) < 1e-8, F.exp(-z / sigma))
        .when(base > 0, F.pow(base, -1.0 / gamma))
        .otherwise(0.0)
    )


def threshold_for(t: Column, sigma: Column, gamma: Column, ratio: Column, tiny: float = 1e-6) -> Column:
    """The line a tail crosses with probability q, where ``ratio`` is q * n / n_t."""
    return F.when(F.abs(gamma) < tiny, t - sigma * F.log(ratio)).otherwise(
        t + sigma / gamma * (F.pow(ratio, -gamma) - 1.0)
    )


def rate_for(t: Column, sigma: Column, gamma: Column, share: Column, z: Column, tiny: float = 1e-6) -> Column:
    """How often a typed line ``z`` would be crossed: the inverse of ``threshold_for``."""
    base = 1.0 + gamma * (z - t) / sigma
    return (
        F.when(F.abs(gamma) < tiny, share * F.exp(-(z - t) / sigma))
        .when(base <= 0, 0.0)
        .otherwise(share * F.pow(base, -1.0 / gamma))
    )


def long_run_factor(rho: Column) -> Column:
    """How much wider a running sum spreads under lag-one autocorrelation."""
    held = F.least(F.greatest(rho, F.lit(0.0)), F.lit(0.995))
    return F.sqrt((1.0 + held) / (1.0 - held))


def erf(x: Column, terms: int = 120) -> Column:
    """Error function by its all-positive series, accurate to rounding for |x| <= 6, 1 beyond."""
    a = F.least(F.abs(x), F.lit(6.0))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda acc, i: F.struct(
            (acc["term"] * 2.0 * a * a / (2 * i + 1)).alias("term"),
            (acc["total"] + acc["term"] * 2.0 * a * a / (2 * i + 1)).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.signum(x) * F.least(
        F.lit(1.0), F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-a * a) * total
    )


def gaussian_nll(y: Column, mean: Column, std: Column) -> Column:
    z = (y - mean) / std
    return 0.5 * F.log(2.0 * F.lit(math.pi) * std * std) + 0.5 * z * z


def gaussian_crps(y: Column, mean: Column, std: Column) -> Column:
    z = (y - mean) / std
    pdf = F.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)
    cdf = 0.5 * (1.0 + erf(z / math.sqrt(2.0)))
    return std * (z * (2.0 * cdf - 1.0) + 2.0 * pdf - 1.0 / math.sqrt(math.pi))


def median_of(values: Column) -> Column:
    """Median of an array of non-null doubles."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(
        n > 0,
        (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0,
    )

"""Count distributions as array columns 0..k, by row-local expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def log_factorial(k: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.when(i > 0, F.ln(i.cast("double"))).otherwise(0.0))


def log_rising(r: Column, k: Column) -> Column:
    """lgamma(r + k) - lgamma(r) for whole k."""
    return F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda a, i: a + F.when(i < k, F.ln(r + i)).otherwise(0.0))


def poisson_logpmf(k: Column, mu: Column) -> Column:
    m = F.greatest(mu, F.lit(FLOOR))
    return k * F.ln(m) - m - log_factorial(k)


def nb2_logpmf(k: Column, mu: Column, alpha: Column | float) -> Column:
    """Variance mu + alpha mu^2; alpha 0 is Poisson, a negative one is an error."""
    a = F.lit(alpha).cast("double") if not isinstance(alpha, Column) else alpha
    m, r = F.greatest(mu, F.lit(FLOOR)), 1 / F.when(a > 0, a)
    nb = log_rising(r, k) - log_factorial(k) - (k + r) * F.log1p(a * m) + k * (F.ln(a) + F.ln(m))
    return F.when(a < 0, F.raise_error(F.lit("alpha is negative")).cast("double")).when(a == 0, poisson_logpmf(k, mu)).otherwise(nb)


def _series(max_count: int, ratio: Callable[[int], float], x: Column) -> Column:
    """p(0) = 1, p(k) = p(k-1) * ratio(k) * x, normalised on 0..max_count.

    Each entry is a plain expression and the sum is a nested product, so that no array function runs row by row.
    """
    total, log_x, logs = F.lit(1.0), F.ln(x), [0.0]
    for k in range(max_count, 0, -1):
        total = 1 + ratio(k) * x * total
    for k in range(1, max_count + 1):
        logs.append(logs[-1] + math.log(ratio(k)))
    return F.array(*[F.exp(k * log_x + c) / total for k, c in enumerate(logs)])


def poisson_pmf(mu: Column, max_count: int = 20) -> Column:
    return _series(max_count, lambda k: 1 / k, F.greatest(mu, F.lit(FLOOR)))


def nb2_pmf(mu: Column, alpha: float, max_count: int = 20) -> Column:
    if alpha < 0:
        raise ValueError("alpha is negative")
    if alpha == 0:
        return poisson_pmf(mu, max_count)
    m, r = F.greatest(mu, F.lit(FLOOR)), 1 / alpha
    return _series(max_count, lambda k: (k - 1 + r) / k, alpha * m / (1 + alpha * m))


def mixture_pmf(mu: Column, weight: float, multiplier: float, max_count: int = 20) -> Column:
    return F.zip_with(poisson_pmf(mu * multiplier, max_count), poisson_pmf(mu / multiplier, max_count), lambda a, b: weight * a + (1 - weight) * b)


def prob_over_column(pmf: Column, threshold: Column) -> Column:
    """The chance of more than a threshold that is a column."""
    return F.aggregate(F.transform(pmf, lambda p, k: F.when(k > threshold, p).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def prob_over(pmf: Column, threshold: float) -> Column:
    first = int(threshold // 1) + 1
    return F.aggregate(F.slice(pmf, first + 1, 10_000), F.lit(0.0), lambda a, x: a + x)


def _cumulative(pmf: Column, max_count: int) -> list[Column]:
    cdf = [F.get(pmf, F.lit(0))]
    for k in range(1, max_count + 1):
        cdf.append(cdf[-1] + F.get(pmf, F.lit(k)))
    return cdf


def quantile(pmf: Column, q: float, max_count: int | None = None) -> Column:
    """The smallest k whose cumulative probability reaches q. max_count: the last entry, where it is known for all rows; it is faster."""
    if max_count is not None:
        below = reduce(Column.__add__, [F.when(c < q, 1).otherwise(0) for c in _cumulative(pmf, max_count)])
        return F.when(pmf.isNotNull(), F.least(below, F.lit(max_count)))
    step = lambda acc, x: F.struct((acc.cdf + x).alias("cdf"), (acc.k + F.when(acc.cdf + x < q, 1).otherwise(0)).alias("k"))
    return F.least(F.aggregate(pmf, F.struct(F.lit(0.0).alias("cdf"), F.lit(0).alias("k")), step, lambda a: a.k), F.size(pmf) - 1)


def crps(pmf: Column, y: Column, max_count: int | None = None) -> Column:
    """Ranked probability score of a count. max_count: as in quantile."""
    if max_count is not None:
        return reduce(Column.__add__, [F.pow(c - F.when(F.lit(k) >= y, 1.0).otherwise(0.0), F.lit(2)) for k, c in enumerate(_cumulative(pmf, max_count))])
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0.0).alias("sum"), F.lit(0).alias("k"))

    def step(acc, x):
        cdf = acc.cdf + x
        return F.struct(cdf.alias("cdf"), (acc.sum + F.pow(cdf - F.when(acc.k >= y, 1.0).otherwise(0.0), F.lit(2))).alias("sum"), (acc.k + 1).alias("k"))

    return F.aggregate(pmf, start, step, lambda a: a.sum)


def pmf_nll(pmf: Column, y: Column) -> Column:
    """Minus log of the probability at y; y beyond the array counts as its last entry."""
    return -F.ln(F.greatest(F.element_at(pmf, (F.least(y, F.size(pmf) - 1) + 1).cast("int")), F.lit(1e-12)))


def mid_pit(pmf: Column, y: Column, v: Column | float = 0.5) -> Column:
    """P(Y < y) + v P(Y = y)."""
    at = F.least(y, F.size(pmf) - 1).cast("int")
    below = F.aggregate(F.slice(pmf, F.lit(1), at), F.lit(0.0), lambda a, x: a + x)
    return below + (v if isinstance(v, Column) else F.lit(v)) * F.element_at(pmf, at + 1)


def hash_uniform(*keys: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that follows from the keys; the same under any partitioning."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def randomized_pit(pmf: Column, y: Column, *keys: Column, seed: int = 42) -> Column:
    """P(Y < y) + v P(Y = y) with a v in [0, 1) that follows from the keys: uniform where the forecasts are right."""
    return mid_pit(pmf, y, hash_uniform(*keys, seed=seed))


def shifted_pmf(pmf: Column, total: Column, max_count: int = 20) -> Column:
    """The distribution of total + remaining; what would pass max_count is piled on it."""
    t = F.least(total, F.lit(max_count)).cast("int")
    head = F.slice(pmf, F.lit(1), max_count - t)
    tail = F.aggregate(F.slice(pmf, max_count - t + 1, F.lit(10_000)), F.lit(0.0), lambda a, x: a + x)
    return F.concat(F.array_repeat(F.lit(0.0), t), head, F.array(tail))

"""Tail probabilities, evaluated on aggregated rows only."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# fixed values: the exact rank-sum law is used up to this class size, without ties
EXACT_CLASS = 8
PERIOD = math.lcm(*range(1, EXACT_CLASS + 1))


def normal_two_sided(z: float) -> float:
    """P(|Z| >= z) for z >= 0, P capped at 1 when the continuity correction makes z negative."""
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@lru_cache(maxsize=EXACT_CLASS)
def _numerator(few: int) -> tuple[int, ...]:
    """Coefficients of (1 - q^PERIOD)^(few + 1) / ((1 - q) (1 - q)(1 - q^2)...(1 - q^few))."""
    top = [0] * (PERIOD * (few + 1) + 1)
    for j in range(few + 2):
        top[PERIOD * j] = (-1) ** j * math.comb(few + 1, j)
    for i in (1, *range(1, few + 1)):
        for n in range(i, len(top)):
            top[n] += top[n - i]
    while top and top[-1] == 0:
        top.pop()
    return tuple(top)


def _at_most(few: int, n: int) -> int:
    """Multisets of parts from 1 to *few* with a sum of at most *n*: a coefficient in closed form."""
    if n < 0:
        return 0
    numbers = _numerator(few)
    return sum(numbers[j] * math.comb((n - j) // PERIOD + few, few) for j in range(n % PERIOD, min(n, len(numbers) - 1) + 1, PERIOD))


def rank_sum_exact(u: float, n1: int, n0: int) -> float:
    """Two-sided p of U under the exact permutation law without ties.

    The arrangements with a statistic of at most t are a coefficient of the product of
    (1 - q^(m+i)) / (1 - q^i) over i up to the smaller class, divided by (1 - q). The numerator has
    at most 2^8 terms and the rest a closed form, so the cost does not grow with the classes; all
    counts are exact integers.
    """
    few, many = min(n1, n0), max(n1, n0)
    most = n1 * n0 - math.ceil(max(u, n1 * n0 - u))
    tail = 0
    for taken in range(few + 1):
        for parts in combinations(range(many + 1, many + few + 1), taken):
            tail += (-1) ** taken * _at_most(few, most - sum(parts))
    return min(1.0, 2 * tail / math.comb(n1 + n0, few))


def rank_sum_p(u: float, n1: float, n0: float, ties: float) -> float:
    """Two-sided p of a rank-sum statistic; *ties* is the sum of t^3 - t over tied groups."""
    if min(n1, n0) <= EXACT_CLASS and ties == 0:
        return rank_sum_exact(u, int(n1), int(n0))
    n = n1 + n0
    variance = n1 * n0 / 12.0 * ((n + 1.0) - ties / (n * (n - 1.0)))
    if variance <= 0:
        return 1.0
    centre = n1 * n0 / 2.0
    z = (max(u, n1 * n0 - u) - centre - 0.5) / math.sqrt(variance)
    return normal_two_sided(z)


def _half_step(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)), without subtracting large logarithms."""
    shift = 0.0
    while a < 40:
        shift += math.log1p(0.5 / a)
        a += 1
    r = 1 / (a * a)
    return 0.5 * math.log(a) - (1 / 8 - r * (1 / 192 - r * (1 / 640 - r * 17 / 14336))) / a - shift


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), with the same relative accuracy for all degrees of freedom.

    The incomplete beta function of df / (df + t^2) at (df/2, 1/2), or the complement of its mirror
    image, whichever continued fraction converges fast.
    """
    t = abs(t)
    if math.isinf(t):
        return 0.0
    if t == 0:
        return 1.0
    a, b = df / 2, 0.5
    x, y = df / (df + t * t), t * t / (df + t * t)
    front = math.exp(-a * math.log1p(t * t / df) + b * math.log(y) + _half_step(a)) / math.sqrt(math.pi)
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front / (a * _fraction(a, b, x)))
    return max(0.0, 1.0 - front / (b * _fraction(b, a, y)))


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated until it no longer moves."""
    tiny = 1e-300
    f = c = 1.0
    d, k = 0.0, 0
    while True:
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        if k:
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            step = c * d
            f *= step
            if abs(step - 1) < 1e-15:
                return f
        k += 1


@F.pandas_udf(DoubleType())
def rank_sum_p_value(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
    """Column form of :func:`rank_sum_p`; missing where the statistic is missing."""
    return pd.Series(
        [
            None if pd.isna(a) else rank_sum_p(a, b, c, d)
            for a, b, c, d in zip(u, n1, n0, ties, strict=True)
        ],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def correlation_p_value(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of *n* pairs from the t distribution with n-2 degrees."""

    def p(r: float, size: float) -> float | None:
        if pd.isna(r) or size < 3:
            return None
        if abs(r) >= 1.0:
            return 0.0
        return student_two_sided(r * math.sqrt((size - 2) / ((1 - r) * (1 + r))), int(size) - 2)

    return pd.Series([p(r, size) for r, size in zip(rho, n, strict=True)], dtype="float64")

"""Student's t distribution.

Spark has no t distribution, so the tail is computed in Arrow batches with the
regularised incomplete beta function (continued fraction, modified Lentz). It
runs on aggregated rows: one per tested group.
"""

from __future__ import annotations

import math
from itertools import count

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
#: Terms of the fraction after which it counts as failed.
LONGEST = 10_000_000
#: Above, the next correction to the normal tail is below 1e-15.
NORMAL_FROM = 1e8


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in count(1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < 4e-16:
            return value
        if m > LONGEST:
            raise ArithmeticError(f"no value of the beta function at a={a}, b={b}, x={x}")


def _stirling_rest(z: float) -> float:
    """log gamma(z) less (z - 1/2) log z - z + log(2 pi) / 2, by its asymptotic series; for z from 10 on."""
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z


def _log_beta(a: float, b: float) -> float:
    """log B(a, b). With a large argument the log-gammas are huge and nearly equal, so their difference is taken
    as a series instead."""
    a, b = max(a, b), min(a, b)
    if a < 10.0:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    difference = (b - (a - 0.5) * math.log1p(b / a) - b * math.log(a + b)
                  + _stirling_rest(a) - _stirling_rest(a + b))
    return math.lgamma(b) + difference


def _beta_tail(a: float, b: float, x: float, rest: float) -> float:
    """Regularised incomplete beta I_x(a, b); `rest` is 1 - x, which a difference would not give to full length."""
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    log_front = a * (math.log(x) if rest > 0.5 else math.log1p(-rest)) + b * math.log(rest) - _log_beta(a, b)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, rest) / b


def two_sided_p(t: float, dof: float) -> float:
    """P(|T| >= |t|) for `dof` degrees of freedom; NaN where it is undefined."""
    if t is None or dof is None or math.isnan(t) or math.isnan(dof) or dof <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if dof > NORMAL_FROM:
        return _near_normal(abs(t), dof)
    return _beta_tail(dof / 2.0, 0.5, dof / (dof + t * t), t * t / (dof + t * t))


def _near_normal(t: float, dof: float) -> float:
    """The tail for very many degrees of freedom: the normal tail and its first correction in 1 / dof."""
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    return math.erfc(t / math.sqrt(2)) + 2 * density * (t ** 3 + t) / (4 * dof)


def upper_critical(alpha: float, dof: float) -> float:
    """The t with P(T > t) = alpha, by bisection."""
    if math.isnan(dof) or dof <= 0 or not 0.0 < alpha < 1.0:
        return math.nan
    if alpha > 0.5:
        return -upper_critical(1.0 - alpha, dof)
    low, high = 0.0, 1.0
    while two_sided_p(high, dof) / 2.0 > alpha and high < 1e300:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if two_sided_p(middle, dof) / 2.0 > alpha:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(a, b) for a, b in zip(t.astype(float), dof.astype(float))],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_critical(alpha: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([upper_critical(a, b) for a, b in zip(alpha.astype(float), dof.astype(float))],
                     dtype="float64")

"""Upper-tail probabilities as Pandas UDFs over the small statistic tables.

The tails are computed directly, not as 1 - cdf, so that p-values near 1e-300
keep their digits. One method holds at all sizes, for whole arrays at once: the
factor before a fraction or series comes from differences of Stirling's series,
which lose no digits however many degrees of freedom there are. A fraction or
series that does not settle is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import ship

ship(__name__)

_TINY = 1e-300
_ROUNDS = 1_000_000       # fractions take about the root of the degrees of freedom
_SHIFT = 12               # Stirling's series is taken so far above its argument


def _correction(z: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks, for z of 12 and more."""
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / z ** 2) / z ** 2) / z ** 2) / z ** 2) / z


def _log_gamma(a: np.ndarray) -> np.ndarray:
    z = a + _SHIFT
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + _correction(z) - sum(np.log(a + i) for i in range(_SHIFT))


def _log_gamma_rise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of gamma(a + b) / gamma(a)."""
    z = a + _SHIFT
    return ((z - 0.5) * np.log1p(b / z) + b * np.log(z + b) - b + _correction(z + b) - _correction(z)
            - sum(np.log1p(b / (a + i)) for i in range(_SHIFT)))


def _settled(done: np.ndarray, what: str) -> None:
    if not done.all():
        raise ArithmeticError(f"{what} did not settle within {_ROUNDS} rounds")


def _fraction(first: np.ndarray, term: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """b0 + a1 / (b1 + a2 / (b2 + ...)) by Lentz's method; `term(k)` gives a and b of step k >= 1."""
    solid = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    value = solid(first)
    c, d, done = value, np.zeros_like(value), np.zeros(len(value), dtype=bool)
    for k in range(1, _ROUNDS):
        a, b = term(k)
        d = 1 / solid(b + a * d)
        c = solid(b + a / c)
        value = np.where(done, value, value * c * d)
        done = done | (np.abs(c * d - 1) < 1e-15)
        if done.all():
            break
    _settled(done, "a continued fraction")
    return value


def gamma_tails(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0 and finite x > 0."""
    z = a + _SHIFT
    gap = (x - z) / z
    # x^a e^-x / gamma(a)
    scale = np.exp(a * np.log1p(gap) - z * gap - (_SHIFT - 0.5) * np.log(z) - 0.5 * math.log(2 * math.pi) - _correction(z) + sum(np.log(a + i) for i in range(_SHIFT)))
    out = np.empty(len(a))
    low = x < a + 1
    if low.any():
        p, q = a[low], x[low]
        term = 1 / p
        total, done = term, np.zeros(len(p), dtype=bool)
        for k in range(1, _ROUNDS):
            term = term * q / (p + k)
            total = total + term
            done = term < total * 1e-17
            if done.all():
                break
        _settled(done, "a series")
        out[low] = np.maximum(0.0, 1 - total * scale[low])
    if not low.all():
        p, q = a[~low], x[~low]
        out[~low] = scale[~low] / _fraction(q + 1 - p, lambda k: (-k * (k - p), q + 2 * k + 1 - p))
    return out


def beta_parts(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) for 0 < x < 1, with y = 1 - x given to full precision."""
    turned = (a + b) * y < b
    x, y, a, b = np.where(turned, y, x), np.where(turned, x, y), np.where(turned, b, a), np.where(turned, a, b)
    log = lambda v, rest: np.where(rest < 0.5, np.log1p(-np.minimum(rest, 0.5)), np.log(np.maximum(v, _TINY)))
    least, most = np.minimum(a, b), np.maximum(a, b)
    front = _log_gamma_rise(most, least) - _log_gamma(least) + a * log(x, y) + b * log(y, x)
    over = (a + b) * y - b                                  # a - (a + b) x, without its loss of digits

    def divisor(n: int) -> np.ndarray:
        inner = n + n * (b - n) * x / (a + 2 * n - 1) if n else 0.0
        return inner + (a + n) / (a + 2 * n + 1) * (over + 1 + n * (1 + y))

    def term(n: int) -> tuple[np.ndarray, np.ndarray]:
        return (a + n - 1) / (a + 2 * n - 1) * ((a + b + n - 1) / (a + 2 * n - 1)) * (n * (b - n)) * x * x, divisor(n)

    # the fraction of DiDonato and Morris, whose terms stay exact for large a
    part = np.exp(front) / _fraction(divisor(0), term)
    return np.where(turned, 1 - part, part)


def _over(columns: tuple[np.ndarray, ...], usual: np.ndarray, otherwise: np.ndarray, rule: Callable[..., np.ndarray]) -> np.ndarray:
    """`rule` where `usual` holds, else `otherwise`."""
    out = otherwise.copy()
    if usual.any():
        out[usual] = rule(*(c[usual] for c in columns))
    return out


def chi2_tails(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    sound = (dof > 0) & (x >= 0)
    edge = np.where(~sound, math.nan, np.where(x == 0, 1.0, 0.0))
    return _over((x, dof), sound & (x > 0) & np.isfinite(x), edge, lambda x, dof: gamma_tails(dof / 2, x / 2))


def f_tails(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    sound = (d1 > 0) & (d2 > 0) & ~np.isnan(f)
    edge = np.where(~sound, math.nan, np.where(f <= 0, 1.0, 0.0))
    return _over((f, d1, d2), sound & (f > 0) & np.isfinite(f), edge,
                 lambda f, d1, d2: beta_parts(d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f), d2 / 2, d1 / 2))


def t_tails(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided."""
    return f_tails(t * t, np.ones_like(t), dof)


def _values(rule: Callable[..., np.ndarray], *columns: pd.Series) -> pd.Series:
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        found = rule(*(c.to_numpy(dtype=float, na_value=math.nan) for c in columns))
    return pd.Series(found).astype(object).where(~np.isnan(found), None)


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _values(chi2_tails, x, dof)


@F.pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _values(f_tails, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def t_sf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _values(t_tails, t, dof)

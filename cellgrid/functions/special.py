"""Special functions that Spark lacks, as Arrow batches in numpy; missing cells stay missing."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 400
# From here on, if it is also twice the order squared, Bessel functions are their expansion for large arguments.
FAR = 1000.0
CELLS = 1 << 21
Function = Callable[[np.ndarray], np.ndarray]


def _or_nan(x: Column, value: Column) -> Column:
    """Missing where x is; what pandas hands back as missing elsewhere is NaN."""
    return F.when(x.isNotNull(), F.coalesce(value, F.lit(math.nan)))


def _batched(f: Function) -> Callable[[Column], Column]:
    """A numpy function as a Column function over Arrow batches; NaN stays NaN and missing cells missing."""

    def of(x: Column) -> Column:
        @F.pandas_udf("double")
        def each(v: pd.Series) -> pd.Series:
            a = v.to_numpy(np.float64, na_value=np.nan)
            with np.errstate(all="ignore"):
                return pd.Series(f(a))

        return _or_nan(x, each(x.cast("double")))

    return of


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function: its series of positive terms near 0, the complement beyond."""
    near = np.abs(x) < 3
    a = np.where(near, x, 0.0)
    term = total = a.copy()
    for k in range(1, 90):
        term = term * 2 * a * a / (2 * k + 1)
        total = total + term
    series = 2 / math.sqrt(math.pi) * np.exp(-a * a) * total
    return np.where(near, series, np.sign(x) * (1 - _far_erfc(np.abs(x))))


def _far_erfc(x: np.ndarray) -> np.ndarray:
    """The complement from 3 on, by its continued fraction from the far end."""
    x = np.where(x < 3, 3.0, x)
    below = np.zeros_like(x)
    for k in range(80, 0, -1):
        below = k / 2 / (x + below)
    return np.where(np.isinf(x), 0.0, np.exp(-x * x) / math.sqrt(math.pi) / (x + below))


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.where(x >= 3, _far_erfc(x), 1 - _erf(np.where(x >= 3, 0.0, x)))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Newton's method in the smaller tail, from the quantile's leading term; infinite at 0 and 1, NaN beyond."""
    q = np.minimum(p, 1 - p)
    inside = (q > 0) & (q < 0.5)
    t = np.where(inside, q, 0.25)
    x = np.sqrt(-2 * np.log(2 * t))
    for _ in range(60):
        tail = _erfc(x / math.sqrt(2)) / 2
        slope = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = (tail - t) / slope
        x = x + step / (1 - x * step / 2)
    out = np.where(inside, np.where(p < 0.5, -x, x), np.where(q == 0.5, 0.0, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan))))
    return np.where(np.isnan(p), np.nan, out)


erf = _batched(_erf)
erfc = _batched(_erfc)
ndtri = _batched(_normal_quantile)
erfi = _batched(lambda y: _normal_quantile((y + 1) / 2) / math.sqrt(2))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log |gamma|: Stirling's series from 15 on, the recurrence up to there, reflection below 1/2; infinite at the poles."""
    up = np.where(x < 0.5, 1 - x, x)
    shift, moved = np.zeros_like(up), up.copy()
    for _ in range(15):
        low = moved < 15
        shift = shift + np.where(low, np.log(np.where(low, moved, 1.0)), 0.0)
        moved = moved + low
    inverse, square = 1 / moved, 1 / (moved * moved)
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    value = (moved - 0.5) * np.log(moved) - moved + math.log(2 * math.pi) / 2 + series - shift
    with np.errstate(all="ignore"):  # at the poles
        reflected = np.where(x < 0.5, math.log(math.pi) - np.log(np.abs(np.sin(math.pi * np.fmod(x, 2)))) - value, value)
    return np.where((x <= 0) & (x == np.floor(x)) | np.isinf(x), np.inf, reflected)


def lgamma(x: Column) -> Column:
    """Struct of log |gamma| and gamma's sign."""
    x = x.cast("double")
    whole = x == F.floor(x)
    sign = F.when((x > 0) | whole | (F.pmod(F.floor(x), F.lit(2)) == 0), 1).otherwise(-1)
    return F.struct(_batched(_log_gamma)(x).alias("value"), F.when(x.isNotNull(), sign).alias("sign"))


def _in_parts(x: np.ndarray, steps: int, f: Function) -> np.ndarray:
    """f over parts of x of which the work, steps for each value, fits in CELLS."""
    rows = max(1, CELLS // steps)
    return np.concatenate([f(x[lo : lo + rows]) for lo in range(0, len(x), rows)]) if len(x) else x


def _expansion(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bessel functions of both kinds far from 0, by the terms of the large-argument expansion down to the smallest."""
    mu, term = 4 * n * n, np.ones_like(x)
    p, q = np.ones_like(x), np.zeros_like(x)
    for k in range(1, 12):
        term = term * (mu - (2 * k - 1) ** 2) / (k * 8 * x)
        part = term * (-1) ** (k // 2)
        p, q = (p, q + part) if k % 2 else (p + part, q)
    angle = x - (n / 2 + 0.25) * math.pi
    size = np.sqrt(2 / (math.pi * x))
    return size * (p * np.cos(angle) - q * np.sin(angle)), size * (p * np.sin(angle) + q * np.cos(angle))


def _bessel_j(x: np.ndarray, n: int) -> np.ndarray:
    """Bessel's integral over half a turn, by the midpoint rule, which converges geometrically here; an expansion far out."""
    limit = max(FAR, 2.0 * n * n)
    far = np.abs(x) > limit
    steps = STEPS + 4 * int(np.abs(np.where(far, 0.0, x)).max(initial=0.0)) + 4 * abs(n)
    t = (np.arange(steps) + 0.5) * math.pi / steps
    near = _in_parts(np.where(far, 0.0, x), steps, lambda a: np.cos(n * t[None, :] - a[:, None] * np.sin(t)[None, :]).mean(axis=1))
    sign = np.where((x < 0) & (n % 2 != 0), -1.0, 1.0)
    return np.where(np.isinf(x), 0.0, np.where(far, sign * _expansion(np.where(far & np.isfinite(x), np.abs(x), limit), n)[0], near))


def _bessel_y(x: np.ndarray, n: int) -> np.ndarray:
    """The integral for the second kind: an oscillating part and a decaying tail, by Gauss-Legendre; an expansion far out."""
    limit = max(FAR, 2.0 * n * n)
    far = x > limit
    y = np.where(far, _expansion(np.where(far & np.isfinite(x), x, limit), n)[1], 0.0)
    x = np.where(far, 1.0, x)
    steps = STEPS + int(np.where(x > 0, x, 0.0).max(initial=0.0)) + abs(n)
    nodes, weights = np.polynomial.legendre.leggauss(min(steps, 2000))
    near = _in_parts(x, len(nodes), lambda a: _near_bessel_y(a, n, nodes, weights))
    return np.where(far, y, near)


def _near_bessel_y(x: np.ndarray, n: int, nodes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    t = (nodes + 1) * math.pi / 2
    first = (np.sin(x[:, None] * np.sin(t) - n * t) * weights).sum(axis=1) / 2
    with np.errstate(all="ignore"):
        top = np.arcsinh((60.0 + 40 * abs(n)) / x) + 1
        u = (nodes[None, :] + 1) * top[:, None] / 2
        tail = (np.exp(n * u - x[:, None] * np.sinh(u)) + (-1) ** n * np.exp(-n * u - x[:, None] * np.sinh(u))) * weights
        second = tail.sum(axis=1) * top / (2 * math.pi)
    return np.where(x > 0, first - second, np.where(x == 0, -np.inf, np.nan))


def _bessel(kind: Callable[[np.ndarray, int], np.ndarray], n: int) -> Callable[[Column], Column]:
    def of(x: Column) -> Column:
        @F.pandas_udf("double")
        def each(v: pd.Series) -> pd.Series:
            a = v.to_numpy(np.float64, na_value=np.nan)
            with np.errstate(all="ignore"):
                out = np.where(np.isnan(a), np.nan, kind(np.nan_to_num(a, posinf=np.inf, neginf=-np.inf), n))
            return pd.Series(out)

        return _or_nan(x, each(x.cast("double")))

    return of


bessj0, bessj1 = _bessel(_bessel_j, 0), _bessel(_bessel_j, 1)
bessy0, bessy1 = _bessel(_bessel_y, 0), _bessel(_bessel_y, 1)


def bessjn(x: Column, n: int) -> Column:
    return _bessel(_bessel_j, n)(x)


def bessyn(x: Column, n: int) -> Column:
    return _bessel(_bessel_y, n)(x)


def polyroots(coefficients: Column) -> Column:
    """Roots, as an array of (re, im) by real part, of coefficients with the highest order first."""

    @F.pandas_udf("array<struct<re:double,im:double>>")
    def each(v: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else sorted((float(z.real), float(z.imag)) for z in np.roots(np.asarray(c, float))) for c in v])

    return each(coefficients)

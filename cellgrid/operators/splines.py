"""Cubic interpolation along one vector of any length.

Knots are numbered and dealt into ranges of their number.  Monotone slopes need only neighbours.  A spline's
slopes solve a tridiagonal system: each range is eliminated by itself, in terms of the slopes just outside of
it, and the slopes at the ranges' ends, two for each range, are found on the driver.  Probes meet the one
interval that they lie in by an as-of join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.operators import ranged, search
from cellgrid.plans.shared import materialize


@dataclass(frozen=True)
class End:
    """What holds at an end: the method's ``default``, a given ``slope`` or ``curvature``, a difference formula over
    ``three`` or ``four`` points, or a curvature that goes on at the next knot (``smooth``); with ``monotone`` a
    slope that would turn the interpolant against the data is pulled back."""

    kind: str = "default"
    value: float = 0.0
    monotone: bool = False

    @classmethod
    def of_code(cls, code: int, value: float = 0.0) -> End:
        """By number: 0 to 5 in the order above, negative for monotone."""
        kinds = ["default", "slope", "curvature", "three", "four", "smooth"]
        if abs(code) >= len(kinds):
            raise ValueError(f"unknown end condition {code}")
        return cls(kinds[abs(code)], value, code < 0)


DEFAULT = (End(), End())


def tridiagonal(lo: np.ndarray, mid: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of a tridiagonal system with any number of right sides (as columns), by cyclic reduction in whole-array steps."""
    n = len(mid)
    if n == 1:
        return right / mid[:, None]
    odd = np.arange(1, n, 2)
    before = -lo[odd] / mid[odd - 1]
    behind = np.where(odd + 1 < n, -up[odd] / mid[np.minimum(odd + 1, n - 1)], 0.0)
    nxt = np.minimum(odd + 1, n - 1)
    x = np.empty_like(right)
    x[1::2] = tridiagonal(before * lo[odd - 1], mid[odd] + before * up[odd - 1] + behind * lo[nxt], behind * up[nxt], right[odd] + before[:, None] * right[odd - 1] + behind[:, None] * right[nxt])
    even = np.arange(0, n, 2)
    left = np.where((even > 0)[:, None], x[np.maximum(even - 1, 0)], 0.0)
    ahead = np.where((even + 1 < n)[:, None], x[np.minimum(even + 1, n - 1)], 0.0)
    x[0::2] = (right[even] - lo[even][:, None] * left - up[even][:, None] * ahead) / mid[even][:, None]
    return x


def difference_slope(x: np.ndarray, f: np.ndarray) -> float:
    """Derivative at the first of a few points of the polynomial through them."""
    table, out, product = f.astype(float), 0.0, 1.0
    for k in range(1, len(x)):
        table = np.diff(table) / (x[k:] - x[:-k])
        out += table[0] * product
        product *= x[0] - x[k]
    return out


def _tamed(d: float, s: float, monotone: bool) -> float:
    if not monotone:
        return d
    return 0.0 if d * s <= 0 else min(max(d, -3 * abs(s)), 3 * abs(s))


def monotone_end(x: np.ndarray, f: np.ndarray, d: np.ndarray, end: End) -> float:
    """Slope at the first of the given points; ``d`` are the slopes at the next two.  A last end is given turned around."""
    h, s = np.diff(x), np.diff(f) / np.diff(x)
    kind, n = end.kind, len(x)
    if kind in ("three", "four", "smooth") and n < (4 if kind == "four" else 3):
        kind = "default"
    if n == 2 and kind == "default":
        return float(s[0])
    if kind == "default":
        return float(search.pchip_slopes(x[:3], f[:3])[0])
    if kind == "slope":
        got = end.value
    elif kind == "curvature":
        got = (3 * s[0] - d[0] - h[0] * end.value / 2) / 2
    elif kind == "smooth":
        got = (3 * (h[0] * s[1] + h[1] * s[0]) - 2 * (h[0] + h[1]) * d[0] - h[0] * d[1]) / h[1]
    else:
        got = difference_slope(x[: 3 if kind == "three" else 4], f[: 3 if kind == "three" else 4])
    return _tamed(float(got), float(s[0]), end.monotone)


def spline_end(x: np.ndarray, f: np.ndarray, end: End) -> tuple[float, float, float]:
    """The equation ``a * d0 + b * d1 = c`` at the first of the given points: without a condition there is no knot at
    the second (for two points, a line; for three, see ``_equations``).  A last end is given turned around."""
    h, s = np.diff(x), np.diff(f) / np.diff(x)
    kind, n = end.kind, len(x)
    if kind == "smooth" or kind in ("three", "four") and n < (3 if kind == "three" else 4):
        kind = "default"
    if kind == "slope":
        return 1.0, 0.0, end.value
    if kind == "curvature":
        return 2.0, 1.0, float(3 * s[0] - h[0] * end.value / 2)
    if kind in ("three", "four"):
        m = 3 if kind == "three" else 4
        return 1.0, 0.0, difference_slope(x[:m], f[:m])
    if n == 2:
        return 1.0, 1.0, float(2 * s[0])
    return float(h[1]), float(h[0] + h[1]), float(((3 * h[0] + 2 * h[1]) * h[1] * s[0] + h[0] ** 2 * s[1]) / (h[0] + h[1]))


def _numbered(knots: DataFrame, x: str, y: str) -> tuple[DataFrame, int]:
    """Good knots with their number ``_i`` and both neighbours, in a written table, and how many there are."""
    good = knots.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null and _y is not null")
    near = {f"_{c}{k}": (f"_{c}", d) for c in "xy" for k, d in (("p", -1), ("n", 1))}
    held = materialize(ranged.neighbours(ranged.indexed(good, ["_x"]), "_i", near), "knots")
    if not held.where("_xn <= _x").isEmpty():
        raise ValueError("knots must differ")
    return held, held.count()


def _tips(held: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first four knots, and the last four from the end on, as rows (x, y)."""
    rows = sorted((r["_i"], r["_x"], r["_y"]) for r in held.where((F.col("_i") < 4) | (F.col("_i") >= n - 4)).select("_i", "_x", "_y").collect())
    xy = np.array([r[1:] for r in rows])
    return xy[:4], xy[::-1][:4]


def _monotone(held: DataFrame, n: int, ends: tuple[End, End]) -> DataFrame:
    h0, h1 = F.col("_x") - F.col("_xp"), F.col("_xn") - F.col("_x")
    s0, s1 = (F.col("_y") - F.col("_yp")) / h0, (F.col("_yn") - F.col("_y")) / h1
    a, b = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(s0 * s1 > 0, (a + b) / (a / s0 + b / s1)).otherwise(0.0)
    tips = _tips(held, n)
    found = []
    for tip, end in zip(tips, ends, strict=True):
        x, f = tip[:, 0], tip[:, 1]
        d = search.pchip_slopes(x, f)[1:3]
        if n == 3 and found:
            d[1] = found[0]
        found.append(monotone_end(x, f, d, end))
    d = F.when(F.col("_i") == 0, found[0]).when(F.col("_i") == n - 1, found[1]).otherwise(inner)
    return held.withColumn("_d", d)


def _pinned(firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """First and last slopes of each range from rows (a, p, q): each is a - p * (last before) - q * (first behind)."""
    k = len(firsts)
    gain, part = np.zeros((k, 2, 2)), np.zeros((k, 2))
    for n in range(k):
        a, p, q = np.stack([firsts[n], lasts[n]]).T
        m, right = np.eye(2), a.copy()
        if n:
            # the last slope of the range before, in terms of this range's first one
            m[:, 0] -= p * gain[n - 1, 1, 0]
            right -= p * part[n - 1, 1]
        gain[n] = np.linalg.solve(m, np.stack([q, np.zeros(2)]).T)
        part[n] = np.linalg.solve(m, right)
    out = np.zeros((k, 2))
    behind = 0.0
    for n in range(k - 1, -1, -1):
        out[n] = part[n] - gain[n, :, 0] * behind
        behind = out[n, 0]
    return out


def _spline(held: DataFrame, n: int, ends: tuple[End, End], chunk: int) -> DataFrame:
    """Slopes of the spline; where it is a parabola or a line through all knots, as without any end condition for
    three or two, these are the polynomial's.  The inner equations, and those of the ends, are the usual ones of
    continuous second derivatives, and of a third one that is continuous at the second knot."""
    first, last = _tips(held, n)
    if n <= 3 and all(e.kind == "default" for e in ends):
        at = [difference_slope(np.roll(first[:, 0], -k), np.roll(first[:, 1], -k)) for k in range(n)]
        return held.withColumn("_d", F.element_at(F.array(*[F.lit(v) for v in at]), (F.col("_i") + 1).cast("int")))
    begin = spline_end(first[:, 0], first[:, 1], ends[0])
    close = spline_end(last[:, 0], last[:, 1], ends[1])
    h0, h1 = F.col("_x") - F.col("_xp"), F.col("_xn") - F.col("_x")
    s0, s1 = (F.col("_y") - F.col("_yp")) / h0, (F.col("_yn") - F.col("_y")) / h1
    pick = lambda a, b, inner: F.when(F.col("_i") == 0, F.lit(float(a))).when(F.col("_i") == n - 1, F.lit(float(b))).otherwise(inner)
    rows = held.select(F.floor(F.col("_i") / chunk).cast("long").alias("_c"), "_i", pick(0.0, close[1], h1).alias("lo"), pick(begin[0], close[0], 2 * (h0 + h1)).alias("mid"), pick(begin[1], 0.0, h0).alias("up"), pick(begin[2], close[2], 3 * (h1 * s0 + h0 * s1)).alias("b"))

    def local(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("_i")
        lo, mid, up = (g[c].to_numpy(float) for c in ("lo", "mid", "up"))
        right = np.zeros((len(g), 3))
        right[:, 0], right[0, 1], right[-1, 2] = g["b"], lo[0], up[-1]
        a, p, q = tridiagonal(lo, mid, up, right).T
        return pd.DataFrame({"_c": g["_c"], "_i": g["_i"], "a": a, "p": p, "q": q})

    solved = materialize(rows.groupBy("_c").applyInPandas(local, "_c long, _i long, a double, p double, q double"), "eliminated")
    edges = solved.where((F.col("_i") % chunk == 0) | (F.col("_i") % chunk == chunk - 1) | (F.col("_i") == n - 1)).select("_i", "a", "p", "q").collect()
    by_place = {r["_i"]: (r["a"], r["p"], r["q"]) for r in edges}
    ranges = -(-n // chunk)
    tips = _pinned(np.array([by_place[c * chunk] for c in range(ranges)]), np.array([by_place[min(n, (c + 1) * chunk) - 1] for c in range(ranges)]))
    outside = [(c, float(tips[c - 1, 1]) if c else 0.0, float(tips[c + 1, 0]) if c + 1 < ranges else 0.0) for c in range(ranges)]
    known = F.broadcast(held.sparkSession.createDataFrame(outside, "_c long, left double, right double"))  # a row for each range
    slopes = solved.join(known, "_c").select("_i", (F.col("a") - F.col("p") * F.col("left") - F.col("q") * F.col("right")).alias("_d"))
    return held.join(slopes, "_i")


def slopes(knots: DataFrame, x: str, y: str, method: str = "pchip", ends: tuple[End, End] = DEFAULT, chunk: int = ranged.CHUNK) -> DataFrame:
    """``(i, x, y, d)``: the knots in order with the interpolant's derivative at each.

    ``pchip`` is monotone where the data are and has an extremum where these turn; ``spline`` has continuous second
    derivatives.  Knots with a missing part are left out; two at one place are an error; fewer than two have no slope.
    """
    held, n = _numbered(knots, x, y)
    if n < 2:
        found = held.withColumn("_d", F.lit(None).cast("double"))
    elif method == "pchip":
        found = _monotone(held, n, ends)
    elif method == "spline":
        found = _spline(held, n, ends, chunk)
    else:
        raise ValueError(f"unknown method {method}")
    return found.select(F.col("_i").alias("i"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_d").alias("d"))


def _intervals(knots: DataFrame, x: str, y: str, method: str, ends: tuple[End, End], chunk: int) -> DataFrame:
    """Knots ``(x, y, d)`` with the next one's, in a written table: one row for each interval."""
    known = materialize(slopes(knots, x, y, method, ends, chunk), "slopes")
    return materialize(ranged.neighbours(known, "i", {f"{c}1": (c, 1) for c in "xyd"}).where("x1 is not null"), "intervals")


def _hermite(x0: Column, y0: Column, d0: Column, x1: Column, y1: Column, d1: Column, v: Column) -> tuple[Column, Column]:
    """Value and derivative of an interval's cubic."""
    h = x1 - x0
    s, u = (y1 - y0) / h, v - x0
    c2, c3 = (3 * s - 2 * d0 - d1) / h, (d0 + d1 - 2 * s) / (h * h)
    return y0 + u * (d0 + u * (c2 + u * c3)), d0 + u * (2 * c2 + 3 * u * c3)


def interpolate(knots: DataFrame, x: str, y: str, probes: DataFrame, v: str, method: str = "pchip", ends: tuple[End, End] = DEFAULT, chunk: int = ranged.CHUNK) -> DataFrame:
    """Probe rows with ``value`` and ``slope``; beyond the knots the first and last cubic go on.  Null for a missing
    probe, and for all if there are fewer than two knots."""
    spans = _intervals(knots, x, y, method, ends, chunk)
    first = spans.where("i = 0").select(F.struct("x", "y", "d", "x1", "y1", "d1").alias("_first"))
    run = search._running(spans, "x", ["y", "d", "x1", "y1", "d1"], probes, v, [], True)
    run = run.join(F.broadcast(first), how="left")  # one row, or none
    at = F.coalesce(F.col("_left"), F.col("_first"))
    value, slope = _hermite(*[at[c] for c in ("x", "y", "d", "x1", "y1", "d1")], F.col("_x"))
    known = F.col("_x").isNotNull()
    return run.select("_probe.*", F.when(known, value).alias("value"), F.when(known, slope).alias("slope"))


def integral(knots: DataFrame, x: str, y: str, a: float, b: float, method: str = "pchip", ends: tuple[End, End] = DEFAULT, chunk: int = ranged.CHUNK) -> DataFrame:
    """One row ``integral``: of the interpolant from a to b, the end cubics going on; null with fewer than two knots."""
    spans = _intervals(knots, x, y, method, ends, chunk)
    last = spans.agg(F.max("i")).first()[0]
    low, high = min(a, b), max(a, b)
    start = F.when(F.col("i") == 0, F.lit(low)).otherwise(F.greatest(F.col("x"), F.lit(low)))
    stop = F.when(F.col("i") == F.lit(last), F.lit(high)).otherwise(F.least(F.col("x1"), F.lit(high)))
    # two-point Gauss rules are exact for cubics
    mid, half = (start + stop) / 2, (stop - start) / 2
    columns = [F.col(c) for c in ("x", "y", "d", "x1", "y1", "d1")]
    area = sum((_hermite(*columns, mid + sign * half / 3**0.5)[0] for sign in (-1, 1)), F.lit(0.0)) * half
    return spans.agg((F.lit(1.0 if b >= a else -1.0) * F.sum(F.when(stop > start, area).otherwise(0.0))).alias("integral"))

"""Search in sorted knots and interpolation, as as-of joins: a union, and running windows over it.

No probe meets more than its own neighbours.  With ``by`` every group has knots of its own; without, the
knots are one vector: knots and probes are then dealt into ranges of the value, as many as there are shuffle
partitions, and the running state of one range is carried into the next from one summary row per range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.operators import ranged
from cellgrid.plans.shared import materialize

def _running(knots: DataFrame, x: str, payload: list[str], probes: DataFrame, v: str, by: list[str], inclusive: bool) -> DataFrame:
    """Probe rows with ``_below``, the knots before them, and ``_left``, the payload of the last one."""
    kind = F.lit(0 if inclusive else 1)
    k = knots.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), kind.alias("_o"), F.struct(*[F.col(c) for c in [x, *payload]]).alias("_knot"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("_probe"))
    p = probes.select(*by, F.col(v).cast("double").alias("_x"), F.lit(0 if not inclusive else 1).alias("_o"), F.lit(None).cast(k.schema["_knot"].dataType).alias("_knot"), F.struct("*").alias("_probe"))
    both = k.unionAll(p)
    run = lambda keys: Window.partitionBy(*keys).orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda w: {"_below": F.count("_knot").over(w), "_left": F.last("_knot", ignorenulls=True).over(w)}
    if by:
        return both.withColumns(seen(run(by))).where("_probe is not null")
    # equal values may lie in several ranges, as their order goes on with a hash of the row
    part = ranged.ranges(both, ["_x", "_o", F.xxhash64("_knot", "_probe")])
    latest = F.max_by("_knot", F.when(F.col("_knot").isNotNull(), F.struct("_x", F.xxhash64("_knot", "_probe"))))
    sums = part.groupBy("_r").agg(F.struct(F.count("_knot").alias("n"), latest.alias("k")).alias("_t"))
    prior = ranged.carried(sums, lambda a, b: (a[0] + b["n"], b["k"] or a[1]), (0, None), "_r")
    joined = part.withColumns(seen(run(["_r"]))).where("_probe is not null").join(prior, "_r")
    return joined.withColumns({"_below": F.col("_below") + F.col("_before.n"), "_left": F.coalesce("_left", "_before.k")}).drop("_r", "_before")


def vsearch(knots: DataFrame, x: str, probes: DataFrame, v: str, mode: str = "sample", by: list[str] | None = None, out: str = "found") -> DataFrame:
    """Place of each probe among ascending knots.

    insert_leftmost and insert_rightmost: where it would go in, before or after equal knots; sample: the first
    knot not below it, at most the last; match: an equal knot's place, else -(insertion + 1); bin_inclusive and
    bin_exclusive: the bin whose left edge is at or below it, or below it, -1 under all edges.
    """
    by = by or []
    inclusive = mode in ("insert_rightmost", "bin_inclusive", "match")
    run = _running(knots, x, [], probes, v, by, inclusive)
    below = F.col("_below")
    if mode == "match":
        hit = run.withColumn(out, F.when(F.col(f"_left.{x}").cast("double") == F.col("_x"), F.col("_below") - 1).otherwise(-F.col("_below") - 1))
        return hit.select("_probe.*", F.col(out).cast("long"))
    if mode == "sample":
        sizes = knots.groupBy(*by).agg((F.count(x) - 1).alias("_last"))
        run = ranged.same_keys(run, sizes, by, "left") if by else run.crossJoin(F.broadcast(sizes))  # one row
        found: Column = F.when(F.col("_last").isNotNull(), F.least(below, F.col("_last")))
    elif mode.startswith("bin"):
        found = below - 1
    elif mode.startswith("insert"):
        found = below
    else:
        raise ValueError(f"unknown search mode {mode}")
    return run.select("_probe.*", found.cast("long").alias(out))


def vsearchvec(knots: DataFrame, columns: list[str], probes: DataFrame, wanted: list[str], out: str = "found") -> DataFrame:
    """Place of each vector among sorted distinct ones: an equal one's, else where it would go in.

    Vectors are held in columns of one type and compare lexicographically; ``knots`` need not be ordered.
    """
    kind = probes.select(F.struct("*")).schema[0].dataType
    key = lambda names: F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(names)])
    k = knots.select(key(columns).alias("_x"), F.lit(1).alias("_o"), F.lit(None).cast(kind).alias("_probe")).distinct()
    p = probes.select(key(wanted).alias("_x"), F.lit(0).alias("_o"), F.struct("*").alias("_probe"))
    held = ranged.ranges(k.unionAll(p), ["_x", "_o", F.xxhash64("_probe")])
    prior = ranged.carried(held.groupBy("_r").agg(F.sum("_o").alias("_t")), lambda a, b: a + b, 0, "_r")
    w = Window.partitionBy("_r").orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, 0)
    run = held.withColumn("_n", F.sum("_o").over(w)).where("_probe is not null").join(prior, "_r")
    return run.select("_probe.*", (F.col("_n") + F.col("_before")).alias(out))


def interpolate(knots: DataFrame, x: str, y: str, probes: DataFrame, v: str, by: list[str] | None = None, out: str = "yi") -> DataFrame:
    """Linear interpolation; outside the knots the end segments are extended and ``err`` is 1.

    Missing keys are equal to each other.  Probes of a group without knots have no value, and ``err`` is 1.
    """
    by = by or []
    near = {"_x1": (x, 1), "_y1": (y, 1), "_x0": (x, -1), "_y0": (y, -1)}
    if by:
        w = Window.partitionBy(*by).orderBy(x)
        spans = knots.select(*by, x, y, *[(F.lead(c, 1) if k > 0 else F.lag(c, 1)).over(w).alias(n) for n, (c, k) in near.items()])
    else:
        spans = materialize(ranged.neighbours(ranged.indexed(knots.select(x, y), [x]), "_i", near), "knots")
    ends = knots.groupBy(*by).agg(F.min(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("_first"), F.max(x).alias("_hi"))
    second = spans.where("_x0 is null" if by else "_i = 0").select(*by, F.col("_x1").alias("_sx"), F.col("_y1").alias("_sy"))
    ends = ranged.same_keys(ends, second, by) if by else ends.crossJoin(F.broadcast(second))  # one row each
    run = _running(spans, x, [y, "_x1", "_y1", "_x0", "_y0"], probes, v, by, True)
    run = ranged.same_keys(run, ends, by, "left") if by else run.crossJoin(F.broadcast(ends))
    under, top = F.col("_left").isNull(), F.col("_left._x1").isNull()
    xa = F.when(under, F.col("_first.x")).when(top, F.col("_left._x0")).otherwise(F.col(f"_left.{x}"))
    ya = F.when(under, F.col("_first.y")).when(top, F.col("_left._y0")).otherwise(F.col(f"_left.{y}"))
    xb = F.when(under, F.col("_sx")).when(top, F.col(f"_left.{x}")).otherwise(F.col("_left._x1"))
    yb = F.when(under, F.col("_sy")).when(top, F.col(f"_left.{y}")).otherwise(F.col("_left._y1"))
    value = ya + (F.col("_x") - xa) * F.try_divide(yb - ya, xb - xa)
    err = (under | (F.col("_x") > F.col("_hi"))).cast("int")
    return run.select("_probe.*", value.alias(out), err.alias("err"))


# Hermite interpolation: a group's knots are one small vector, evaluated per group in numpy -------------


def pchip_slopes(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Monotone derivatives: weighted harmonic means inside, three-point one-sided estimates at the ends."""
    h, s = np.diff(x), np.diff(f) / np.diff(x)
    if len(x) == 2:
        return np.array([s[0], s[0]])
    d = np.zeros(len(x))
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        d[1:-1] = np.where(s[:-1] * s[1:] > 0, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0.0)

    def end(h0: float, h1: float, s0: float, s1: float) -> float:
        e = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        if e * s0 <= 0:
            return 0.0
        return 3 * s0 if s0 * s1 < 0 and abs(e) > 3 * abs(s0) else e

    d[0], d[-1] = end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2])
    return d


def spline_slopes(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Derivatives of the cubic spline with no knot at the second and last but one points (a parabola for three)."""
    n, h, s = len(x), np.diff(x), np.diff(f) / np.diff(x)
    if n == 2:
        return np.array([s[0], s[0]])
    # bands of a tridiagonal system: before, on and behind the diagonal
    lo, mid, up, b = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    lo[1:-1], mid[1:-1], up[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
    b[1:-1] = 3 * (h[1:] * s[:-1] + h[:-1] * s[1:])
    if n == 3:
        mid[0], up[0], b[0] = 1, 1, 2 * s[0]
        lo[2], mid[2], b[2] = 1, 1, 2 * s[1]
    else:
        mid[0], up[0] = h[1], h[0] + h[1]
        b[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * s[0] + h[0] ** 2 * s[1]) / (h[0] + h[1])
        lo[-1], mid[-1] = h[-1] + h[-2], h[-2]
        b[-1] = (h[-1] ** 2 * s[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * s[-1]) / (h[-1] + h[-2])
    for i in range(1, n):
        ratio = lo[i] / mid[i - 1]
        mid[i] -= ratio * up[i - 1]
        b[i] -= ratio * b[i - 1]
    b[-1] /= mid[-1]
    for i in range(n - 2, -1, -1):
        b[i] = (b[i] - up[i] * b[i + 1]) / mid[i]
    return b


def hermite(x: np.ndarray, f: np.ndarray, d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and derivative at given places of the piecewise cubic."""
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    t, s = (at - x[k]) / h, (f[k + 1] - f[k]) / h
    c2, c3 = 3 * s - 2 * d[k] - d[k + 1], d[k] + d[k + 1] - 2 * s
    u = t * h
    return f[k] + u * (d[k] + t * (c2 + t * c3)), d[k] + t * (2 * c2 + 3 * t * c3)


def hermite_integral(x: np.ndarray, f: np.ndarray, d: np.ndarray, a: float, b: float) -> float:
    """Definite integral of the piecewise cubic, exact on each piece by two-point Gauss rules."""
    if a > b:
        return -hermite_integral(x, f, d, b, a)
    edges = np.concatenate([[a], x[(x > a) & (x < b)], [b]])
    mid, half = (edges[1:] + edges[:-1]) / 2, np.diff(edges) / 2
    return float(sum((half * hermite(x, f, d, mid + sign * half / np.sqrt(3))[0]).sum() for sign in (-1, 1)))


def cubic_interpolate(knots: DataFrame, by: list[str], x: str, y: str, probes: DataFrame, v: str, method: str = "pchip") -> DataFrame:
    """``value`` and ``slope`` at each probe from its group's knots, by ``pchip`` or ``spline``; null for fewer than two knots."""
    packed = knots.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_k"))
    both = ranged.same_keys(probes, packed, by, "left")
    slopes = {"pchip": pchip_slopes, "spline": spline_slopes}[method]

    @F.pandas_udf("value double, slope double")
    def of(xs: pd.Series, ys: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows, held = [], {}
        for a, b, t in zip(xs, ys, at, strict=True):
            if a is None or len(a) < 2 or pd.isna(t):
                rows.append((None, None))
                continue
            key = a.tobytes() + b.tobytes()
            if key not in held:
                held[key] = slopes(a, b)
            value, slope = hermite(a, b, held[key], np.array([t]))
            rows.append((value[0], slope[0]))
        return pd.DataFrame(rows, columns=["value", "slope"]).astype(float)

    got = of(F.col("_k.x"), F.col("_k.y"), F.col(v).cast("double"))
    return both.withColumn("_g", got).select(*probes.columns, "_g.value", "_g.slope")


def integrate(knots: DataFrame, by: list[str], x: str, y: str, a: float, b: float, method: str = "pchip", out: str = "integral") -> DataFrame:
    """Definite integral from a to b of each group's interpolant."""
    slopes = {"pchip": pchip_slopes, "spline": spline_slopes}[method]

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values(x)
        xs, ys = g[x].to_numpy(float), g[y].to_numpy(float)
        value = hermite_integral(xs, ys, slopes(xs, ys), a, b) if len(g) > 1 else None
        return pd.DataFrame({**{c: g[c].iloc[:1] for c in by}, out: [value] * min(1, len(g))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in knots.select(*by).schema) + f", {out} double"
    return knots.select(*by, x, y).groupBy(*by).applyInPandas(each, schema)

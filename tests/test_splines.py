"""Splines along one vector: any number of ranges gives what one gives, and the published derivatives."""

import numpy as np
import pytest

from cellgrid.operators import search, sequences, splines
from cellgrid.operators.splines import End

X = np.arange(10.0)
SQUARE = X**2 + 43.3
CUBE = X**3 - 23


def frame(spark, x, y):
    rows = [(float(a), float(b), "s") for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame(rows[::-1], "x double, y double, d string").repartition(3)


def slopes(spark, x, y, **kw):
    return [r["d"] for r in splines.slopes(frame(spark, x, y), "x", "y", **kw).orderBy("i").collect()]


def test_tridiagonal():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 101):
        m = np.diag(rng.uniform(3, 4, n)) + np.diag(rng.uniform(-1, 1, n - 1), 1) + np.diag(rng.uniform(-1, 1, n - 1), -1)
        lo, up = np.append(0, np.diag(m, -1)), np.append(np.diag(m, 1), 0)
        right = rng.normal(size=(n, 3))
        np.testing.assert_allclose(splines.tridiagonal(lo, np.diag(m).copy(), up, right), np.linalg.solve(m, right), rtol=1e-10)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1000])
def test_spline_in_ranges(spark, chunk):
    rng = np.random.default_rng(chunk)
    x, y = np.cumsum(rng.uniform(0.2, 2, 40)), rng.normal(size=40)
    np.testing.assert_allclose(slopes(spark, x, y, method="spline", chunk=chunk), search.spline_slopes(x, y), rtol=1e-9)


def test_published_slopes(spark):
    """Derivatives of a square and a cube at whole places."""
    np.testing.assert_allclose(slopes(spark, X, SQUARE, method="spline", chunk=4), 2 * X, atol=1e-9)
    np.testing.assert_allclose(slopes(spark, X, CUBE, method="spline", chunk=4), 3 * X**2, atol=1e-9)
    np.testing.assert_allclose(slopes(spark, X, SQUARE), [0, 1.5, 3.75, 5.8333333, 7.875, 9.9, 11.916667, 13.928571, 15.9375, 18], atol=1e-6)
    np.testing.assert_allclose(slopes(spark, X, CUBE), [0, 1.75, 10.230769, 25.107143, 46.061224, 73.039474, 106.02752, 145.02027, 190.01554, 241], atol=1e-5)


@pytest.mark.parametrize("code", range(6))
def test_end_conditions(spark, code):
    """A cubic meets every condition that is told the truth about it; four points tell its end slopes, three do not."""
    x = np.array([0.0, 0.5, 1.25, 2.0, 3.0, 3.5])
    f, d, c = x**3 - x, 3 * x**2 - 1, 6 * x
    told = {1: d, 2: c}.get(code, np.zeros(6))
    ends = (End.of_code(code, told[0]), End.of_code(code, told[-1]))
    got = slopes(spark, x, f, method="spline", ends=ends, chunk=2)
    if code == 3:
        second = lambda i, j, k: (f[j] - f[i]) / (x[j] - x[i]) + ((f[j] - f[i]) / (x[j] - x[i]) - (f[k] - f[j]) / (x[k] - x[j])) / (x[k] - x[i]) * (x[j] - x[i])
        assert got[0] == pytest.approx(second(0, 1, 2)) and abs(got[0] - d[0]) > 0.1
    else:
        np.testing.assert_allclose(got, d, atol=1e-9)
    got = slopes(spark, x, f, ends=ends)
    inner = slopes(spark, x, f)
    assert got[1:-1] == inner[1:-1]
    if code in (1, 4):
        np.testing.assert_allclose([got[0], got[-1]], d[[0, -1]], atol=1e-9)
    if code == 2:
        h, s = x[1] - x[0], (f[1] - f[0]) / (x[1] - x[0])
        assert (6 * s - 4 * got[0] - 2 * got[1]) / h == pytest.approx(0)  # the curvature at the first knot
    if code == 5:
        h, s = np.diff(x), np.diff(f) / np.diff(x)
        left, right = (2 * got[0] + 4 * got[1] - 6 * s[0]) / h[0], (6 * s[1] - 4 * got[1] - 2 * got[2]) / h[1]
        assert left == pytest.approx(right)  # the same on both sides of the second knot


def test_monotone_ends_and_few_knots(spark):
    x, f = [0.0, 1.0, 2.0], [0.0, 1.0, 1.5]
    assert slopes(spark, x, f, ends=(End("slope", 9.0, True), End("slope", -1.0, True)))[::2] == [3.0, 0.0]
    assert slopes(spark, x, f, ends=(End("slope", 9.0), End("slope", -1.0)))[::2] == [9.0, -1.0]
    assert slopes(spark, [1.0, 3.0], [0.0, 4.0]) == slopes(spark, [1.0, 3.0], [0.0, 4.0], method="spline") == [2.0, 2.0]
    np.testing.assert_allclose(slopes(spark, x, f, method="spline"), [1.25, 0.75, 0.25])
    assert slopes(spark, [1.0], [0.0]) == [None] and slopes(spark, [], []) == []
    with pytest.raises(ValueError, match="differ"):
        slopes(spark, [1.0, 1.0], [0.0, 1.0])
    with pytest.raises(ValueError, match="condition"):
        End.of_code(6)


@pytest.mark.parametrize("method", ["pchip", "spline"])
def test_values_and_areas(spark, method):
    rng = np.random.default_rng(5)
    x, y = np.sort(rng.uniform(0, 10, 30)), rng.normal(size=30)
    d = {"pchip": search.pchip_slopes, "spline": search.spline_slopes}[method](x, y)
    at = np.concatenate([rng.uniform(-1, 11, 40), x, [None]])
    probes = spark.createDataFrame([(n, None if v is None else float(v)) for n, v in enumerate(at)], "n int, v double")
    got = {r["n"]: (r["value"], r["slope"]) for r in splines.interpolate(frame(spark, x, y), "x", "y", probes, "v", method, chunk=4).collect()}
    value, slope = search.hermite(x, y, d, at[:-1].astype(float))
    np.testing.assert_allclose([got[n][0] for n in range(70)], value, rtol=1e-8, atol=1e-8)
    np.testing.assert_allclose([got[n][1] for n in range(70)], slope, rtol=1e-8, atol=1e-8)
    assert got[70] == (None, None)
    for a, b in ((2.0, 7.5), (8.0, 1.0), (-1.0, 11.0), (3.0, 3.0)):
        found = splines.integral(frame(spark, x, y), "x", "y", a, b, method, chunk=4).first()[0]
        assert found == pytest.approx(search.hermite_integral(x, y, d, a, b), abs=1e-9)


def test_published_values(spark):
    probes = spark.createDataFrame([(float(np.float32(v + 2.3)),) for v in range(5)], "v double")
    got = splines.interpolate(frame(spark, X, CUBE), "x", "y", probes, "v").orderBy("v").collect()
    np.testing.assert_allclose([r["value"] for r in got], [-10.973827, 12.780893, 56.345513, 125.71307, 226.88177], rtol=1e-5)
    assert splines.integral(frame(spark, X, SQUARE), "x", "y", 3.0, 4.0).first()[0] == pytest.approx(55.6298611111111)
    assert splines.integral(frame(spark, X, CUBE), "x", "y", 3.0, 4.0).first()[0] == pytest.approx(20.7538265306122)


@pytest.mark.parametrize("direction", ["p", "s"])
def test_partial_along_one_vector(spark, direction):
    y = np.random.default_rng(7).normal(size=25).tolist()
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(y)], "g string, i int, v double").repartition(3)
    one, grouped = ({r["i"]: r["partial"] for r in sequences.partial(df, by, ["i"], "v", direction).collect()} for by in ([], ["g"]))
    assert one == pytest.approx(grouped)

"""Cubic and windowed interpolation against sums over all cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.operators import signal


def image(spark, data):
    return spark.createDataFrame([(*place, float(v)) for place, v in np.ndenumerate(data)], "i long, j long, v double")


WEIGHTS = {
    "sinc": np.sinc,
    "sinc2": lambda x: np.sinc(x) ** 2,
    "lanczos": lambda x: np.sinc(x) * np.sinc(x / 2) * (abs(x) < 2),
    "hann": lambda x: (0.5 + 0.5 * np.cos(np.pi * x)) * (abs(x) < 1),
    "hamming": lambda x: (0.54 + 0.46 * np.cos(np.pi * x)) * (abs(x) < 1),
}


def test_cubic_of_a_plane_and_of_random_cells(spark):
    plane = np.arange(10)[:, None] + 10.0 * np.arange(10)
    asked = spark.createDataFrame([(3 + a / 4, 5 + b / 4) for a in range(5) for b in range(5)], "x double, y double")
    at = [F.col("x"), F.col("y")]
    for x, y, v in signal.interp_nd(image(spark, plane), ["i", "j"], [10, 10], asked, at, "cubic").collect():
        assert v == pytest.approx(x + 10 * y)
    data = np.random.default_rng(0).normal(size=(10, 10))

    def line(c, f):  # the curve through the middle two of four, with the slopes of their neighbours
        s0, s1, d = (c[2] - c[0]) / 2, (c[3] - c[1]) / 2, c[2] - c[1]
        return c[1] + f * (s0 + f * (3 * d - 2 * s0 - s1 + f * (s0 + s1 - 2 * d)))

    for x, y, v in signal.interp_nd(image(spark, data), ["i", "j"], [10, 10], asked, at, "cubic").collect():
        i, j = int(x), int(y)
        assert v == pytest.approx(line([line(data[i + k - 1, j - 1 : j + 3], y - j) for k in range(4)], x - i))


@pytest.mark.parametrize("name", [*WEIGHTS, "tanh"])
def test_warps(spark, name):
    data = np.random.default_rng(1).normal(size=(9, 8))
    fit = {"x": [0.25, 1.0, 0.0, 0.0], "y": [-0.625, 0.0, 1.0, 0.0]}
    got = {(r["i"], r["j"]): r["v"] for r in signal.warp2d(image(spark, data), (9, 8), fit, 2, name, -7.0).collect()}
    weights = WEIGHTS.get(name)
    if weights is None:
        f = np.linspace(-3, 3, 60001)  # the box with soft edges, transformed by a sum
        box = (np.tanh(5 * (f + 0.5)) + 1) * (np.tanh(5 * (0.5 - f)) + 1) / 4
        weights = lambda x: np.array([np.sum(box * np.cos(2 * np.pi * f * k)) for k in np.atleast_1d(x)])
    a, b = weights(0.25 - np.arange(-1, 3)), weights(0.375 - np.arange(-1, 3))
    for (i, j), v in got.items():
        inside = 1 <= i <= 6 and 1 <= j - 1 <= 5
        assert v == pytest.approx(a @ data[i - 1 : i + 3, j - 2 : j + 2] @ b / a.sum() / b.sum() if inside else -7.0, abs=1e-6)
    table = signal.warp2d_kernel(spark, name).orderBy("x").collect()
    assert len(table) == 2001 and table[0]["k"] == pytest.approx(1) and table[500]["x"] == 0.5


def test_missing_places_and_cells(spark):
    img = image(spark, np.ones((8, 8)))
    asked = spark.createDataFrame([(3.5, 3.5), (None, 3.5), (3.5, 3.5), (0.0, 0.0)], "x double, y double")
    got = signal.interp_nd(img, ["i", "j"], [8, 8], asked, [F.col("x"), F.col("y")], "cubic").collect()
    assert sorted((r["value"] is None, r["value"] and round(r["value"], 9)) for r in got) == [(False, 1.0)] * 3 + [(True, None)]
    assert signal.interp_nd(img.where("false"), ["i", "j"], [8, 8], asked.limit(1), [F.col("x"), F.col("y")], "lanczos").first()["value"] == 0

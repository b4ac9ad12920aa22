"""Null groups, null places, absent cells, and values that are no numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions import elementwise as E
from cellgrid.operators import histograms, linalg, search, sequences, signal


def test_histogram_keeps_a_null_group(spark):
    df = spark.createDataFrame([(None, 0.5), (None, 2.5), ("a", 1.5), ("a", None)], "g string, v double")
    got = {(r["g"], r["bin"]): r["hist"] for r in histograms.histogram(df, "v", 1.0, 0.0, 3, by=["g"]).collect()}
    assert got == {(None, 0): 1, (None, 1): 0, (None, 2): 1, ("a", 0): 0, ("a", 1): 1, ("a", 2): 0}


def test_probes_of_a_null_group_and_of_none(spark):
    knots = spark.createDataFrame([(g, float(x), 2.0 * x) for g in (None, "a") for x in range(3)], "g string, x double, y double")
    probes = spark.createDataFrame([(None, 0.5, 1), ("a", 1.5, 2), ("b", 1.0, 3)], "g string, v double, n int")
    got = {r["n"]: (r["yi"], r["err"]) for r in search.interpolate(knots, "x", "y", probes, "v", ["g"]).collect()}
    assert got == {1: (1.0, 0), 2: (3.0, 0), 3: (None, 1)}
    assert {r["n"]: r["found"] for r in search.vsearch(knots, "x", probes, "v", "sample", ["g"]).collect()} == {1: 1, 2: 2, 3: None}
    got = {r["n"]: r["value"] for r in search.cubic_interpolate(knots, ["g"], "x", "y", probes, "v").collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(3.0), 3: None}


def test_places_that_are_missing_keep_their_rows(spark):
    img = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(3) for j in range(3)], "i long, j long, v double")
    asked = spark.createDataFrame([(1, 0.5, 1.0), (2, None, 1.0), (3, 1.0, None), (2, None, 1.0), (4, 9.0, 9.0)], "n int, a double, b double")
    for method, first in (("linear", 10.5), ("sample", 11.0)):
        got = sorted((r["n"], r["value"]) for r in signal.resample(img, (3, 3), asked, F.col("a"), F.col("b"), method).collect())
        assert got == [(1, first), (2, None), (2, None), (3, None), (4, 0.0)]


def test_transforms_with_absent_cells(spark):
    x = np.array([1.0, 2, 3, 0, 5, 6])
    cells = spark.createDataFrame([(i, v, 0.0) for i, v in enumerate(x.tolist()) if i != 3], "i long, re double, im double")
    got = {r["i"]: complex(r["re"], r["im"]) for r in signal.fft_cells(cells, [], "i", 2, 3).collect()}
    np.testing.assert_allclose([got[i] for i in range(6)], np.fft.fft(x), atol=1e-12)
    plane = np.arange(12.0).reshape(3, 4)
    plane[1] = 0
    plane[2, 0] = 0
    cells = spark.createDataFrame([(i, j, float(plane[i, j]), 0.0) for i in (0, 2) for j in range(4) if (i, j) != (2, 0)], "i long, j long, re double, im double")
    got = {(r["i"], r["j"]): complex(r["re"], r["im"]) for r in signal.fftnd(cells, [], ["i", "j"]).collect()}
    np.testing.assert_allclose([[got[i, j] for j in range(4)] for i in range(3)], np.fft.fft2(plane), atol=1e-12)
    with pytest.raises(Exception, match="twice, or beyond"):
        signal.fftnd(cells.unionAll(cells), [], ["i", "j"]).collect()


def test_box_with_absent_cells(spark):
    v = np.random.default_rng(1).normal(size=(6, 7))
    rows = [(i, j, float(v[i, j])) for i in range(6) for j in range(7)]
    absent = spark.createDataFrame([r for r in rows if r[:2] != (2, 3)], "i long, j long, v double")
    null = spark.createDataFrame([r if r[:2] != (2, 3) else (2, 3, None) for r in rows], "i long, j long, v double")
    one, two = ({(r["i"], r["j"]): r["v"] for r in signal.box2d(df, [], (6, 7), 3, 3).collect()} for df in (absent, null))
    v[2, 3] = 0
    assert set(two) - set(one) == {(2, 3)}
    for (i, j), x in one.items():
        assert x == two[i, j] == pytest.approx(v[i - 1 : i + 2, j - 1 : j + 2].sum() / 9 if 0 < i < 5 and 0 < j < 6 else v[i, j])


def test_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(0, math.inf), (1, 1.0), (2, 2.0), (3, -math.inf), (4, math.nan), (5, 300.7)], "n int, v double")
    got = histograms.hist(df, "v", step=100.0).orderBy("bin").collect()
    assert [r["hist"] for r in got] == [3, 0, 2]
    got = {r["n"]: (r["b"], r["l"], r["q"]) for r in df.select("n", E.wrap_cast("v", "byte").alias("b"), E.wrap_cast("v", "long").alias("l"), E.wrap_cast("v", "longlong").alias("q")).collect()}
    assert got == {0: (None,) * 3, 1: (1, 1, 1), 2: (2, 2, 2), 3: (None,) * 3, 4: (None,) * 3, 5: (44, 300, 300)}
    assert linalg.solve_tall(spark.createDataFrame([], "x array<double>, y double"), "x", "y") == []


@pytest.mark.parametrize("by", [[], ["g"]])
def test_locf_of_strings(spark, by):
    df = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None), (1, 3, "b")], "g int, i int, s string")
    assert [r["locf"] for r in sequences.locf(df, by, ["i"], "s").orderBy("i").collect()] == [None, "a", "a", "b"]


def test_inverse_functions_of_complex_numbers(spark):
    rng = np.random.default_rng(2)
    z = [complex(*x) for x in rng.normal(size=(20, 2)) * 2]
    df = spark.createDataFrame([(n, c.real, c.imag) for n, c in enumerate(z)], "n int, re double, im double").withColumn("z", E.czip("re", "im"))
    for ours, theirs in ((E.casin, np.arcsin), (E.cacos, np.arccos), (E.cacosh, np.arccosh), (E.catanh, np.arctanh)):
        got = df.select("n", ours("z").alias("w")).orderBy("n").collect()
        np.testing.assert_allclose([complex(r["w"]["re"], r["w"]["im"]) for r in got], theirs(np.array(z)), rtol=1e-9)


def test_stacked_small_matrices(spark):
    rng = np.random.default_rng(3)
    ms = [rng.normal(size=(k, k)).tolist() for k in (2, 3, 2, 3)] + [None, [[1.0, 2.0], [2.0, 4.0]]]
    df = spark.createDataFrame([(n, m, None if m is None else [1.0] * len(m)) for n, m in enumerate(ms)], "n int, m array<array<double>>, b array<double>")
    got = df.select("n", linalg.inv(F.col("m")).alias("i"), linalg.det(F.col("m")).alias("d"), linalg.solve(F.col("m"), F.col("b")).alias("x"), linalg.svd(F.col("m")).alias("s"), linalg.eigenvalues(F.col("m")).alias("e")).orderBy("n").collect()
    for r, m in zip(got[:4], ms[:4], strict=True):
        np.testing.assert_allclose(r["i"], np.linalg.inv(m))
        np.testing.assert_allclose(r["x"], np.linalg.solve(m, np.ones(len(m))))
        assert r["d"] == pytest.approx(np.linalg.det(m)) and np.allclose(np.array(r["s"]["u"]) * r["s"]["s"] @ np.transpose(r["s"]["v"]), m)
        assert np.allclose(np.sort_complex([complex(e["re"], e["im"]) for e in r["e"]]), np.sort_complex(np.linalg.eigvals(m)))
    assert got[4]["i"] is got[4]["d"] is got[4]["x"] is got[5]["i"] is got[5]["x"] is None and got[5]["d"] == pytest.approx(0)
    a, b = E.inner2t(F.col("m"), F.col("m"), F.col("m")), E.combcoords(F.lit(5), F.lit(6), F.lit(7))
    r = df.where("n = 1").select(a.alias("a"), b.alias("b")).first()
    np.testing.assert_allclose(r["a"], np.linalg.matrix_power(np.array(ms[1]), 3))
    assert r["b"] == [5.0, 6.0, 7.0]

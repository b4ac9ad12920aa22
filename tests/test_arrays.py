"""Literal cases of the operators, with missing cells, NaN, ties and empty groups."""

import math
from pathlib import Path
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions import aggregates as A
from cellgrid.functions import elementwise as E
from cellgrid.functions import special as S
from cellgrid.operators import generate, graph, histograms, linalg, ranged, search, selection, sequences, sets, signal, transforms
from cellgrid.plans import shared

NAN, INF = float("nan"), float("inf")


def vector(spark, values, kind="double"):
    return spark.createDataFrame([(i, None if v is None else (float(v) if kind == "double" else v)) for i, v in enumerate(values)], f"i0 long, v {kind}")


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def same(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and (x == pytest.approx(y, rel=1e-5) or (x != x and y != y))) for x, y in zip(a, b, strict=True))


def test_stats(spark):
    v = [1, 2, 3, 3, 5, 2, 3, 4, 5, 6, 13, 13, 13, 13, 13, 1, 3, 1, 3, 1, 10, 10, 2, 2, 2]
    df = vector(spark, v)
    got = sequences.statsover(df, [], "v").first()
    assert same([got[c] for c in ("avg", "prms", "med", "vmin", "vmax", "rms")], [5.36, 4.55411, 3, 1, 13, 4.46210])
    assert tuple(got[c] for c in ("avg", "vmin")) == tuple(df.agg(*A.uniform_stats("v")).first()[c] for c in ("avg", "vmin"))


def test_percentiles(spark):
    df = vector(spark, [0, 0, 6, 3, 5, 0, 7, 14, 94, 5, 5, 8, 7, 7, 1, 6, 7, 13, 10, 2, 101, 19, 7, 7, 5])
    for p, want in ((-0.5, 0), (0, 0), (0.9, 17), (1, 101), (2, 101)):
        assert df.agg(A.pctover("v", p)).first()[0] == pytest.approx(want)
    assert vector(spark, range(10)).agg(A.pctover("v", 0.23)).first()[0] == pytest.approx(2.07)
    for values, p, want in (([1, 2, 3, 4, 5], 0.5, 3), ([1, 2, 3, 4, 5], 0.79, 4), ([1, 0, -1], 0.5, 0), ([-3, 3, -5, 10], 0.1, -5)):
        assert sequences.oddpctover(vector(spark, values), [], "v", p).first()[0] == want
    assert sequences.oddpctover(vector(spark, [-3, 3, -5, 10]), [], "v", 0.5, median=True).first()[0] == -3


def test_percentiles_by_window_and_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(None if k == 2 else k, float(i * 37 % 101 % (9 if k else 50))) for k in range(3) for i in range(40 * k + 1)], "k int, v double")
    few = sequences.pctover(df, ["k"], "v", {"a": 0.3, "b": 0.77}).orderBy("k").collect()
    monkeypatch.setattr(ranged, "FEW_VALUES", 0)
    assert sequences.pctover(df, ["k"], "v", {"a": 0.3, "b": 0.77}).orderBy("k").collect() == few and len(few) == 3


def test_extremes_with_nan(spark):
    for values in ([NAN, 0, 1, 2], [0, 1, 2, NAN]):
        df = vector(spark, values)
        assert tuple(df.agg(A.minimum("v"), A.maximum("v")).first()) == (0, 2)
    assert math.isnan(vector(spark, [NAN, NAN]).agg(A.minimum("v")).first()[0])
    assert tuple(vector(spark, [3, 5, NAN, 5, 3]).agg(*A.minmaximum("v", "i0")).first()) == (3, 5, 0, 1)


def test_folds_of_empty_and_missing(spark):
    none, bad = vector(spark, []), vector(spark, [None, None])
    assert none.agg(A.sumover("v"), A.andover("v"), A.orover("v"), A.zcover("v"), A.nbadover("v")).first()[:] == (0, 1, 0, 1, 0)
    assert bad.agg(A.sumover("v"), A.nbadover("v"), A.ngoodover("v")).first()[:] == (None, 2, 0)
    assert vector(spark, [0, NAN, 2]).agg(A.prodover("v")).first()[0] == 0
    assert vector(spark, [-7, 2], "int").agg(A.average_int("v")).first()[0] == -2
    assert vector(spark, [0, 0, 4, 3]).agg(A.firstnonzeroover("v", "i0"), A.reduce("max", "v")).first()[:] == (4, 4)


def test_mode(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 3, 4, 3, 2)] + [("b", x) for x in (4, 5, 6)] + [("c", 1), ("c", 2), ("c", 2), ("c", 1)], "k string, v int")
    assert dict(sequences.modeover(df, ["k"], "v").collect()) == {"a": 3, "b": 0, "c": 1}


def test_sort_with_missing(spark):
    df = vector(spark, [0, 1, 2, None, NAN, 5, 4])
    ranks = {r["i0"]: r["rank"] for r in sequences.qsorti(df, [], "v", ["i0"]).collect()}
    assert ranks == {0: 0, 1: 1, 2: 2, 6: 3, 5: 4, 4: 5, 3: 6}
    assert [r["v"] for r in sequences.extreme_n(df, [], "v", "i0", 2).orderBy("nth").collect()] == [5, 4]


def test_arithmetic_traps(spark):
    lit = F.lit
    assert same(one(spark, E.divide(lit(1.0), lit(0.0)), E.divide(lit(-1.0), lit(0.0)), E.divide(lit(0.0), lit(0.0)), E.divide(lit(None).cast("double"), lit(0.0))), (INF, -INF, NAN, None))
    assert one(spark, E.modulo(lit(7), lit(-3)), E.modulo(lit(-7), lit(3)), E.modulo(lit(7), lit(0)), E.int_divide(lit(-7), lit(2))) == (-2, 2, 0, -3)
    assert one(spark, E.gt(lit(NAN), lit(1.0)), E.eq(lit(NAN), lit(NAN)), E.ne(lit(NAN), lit(NAN)), E.spaceship(lit(NAN), lit(1.0)), E.gt(lit(None).cast("double"), lit(1.0))) == (0, 0, 1, 1, None)
    assert same(one(spark, E.log(lit(0.0)), E.log(lit(-1.0)), E.log10(lit(100.0)), E.rint(lit(2.5))), (-INF, NAN, 2, 2))
    assert one(spark, E.hclip(lit(1), lit(None).cast("int")), E.clip(lit(9), 0, 5), E.ipow(lit(3), lit(4))) == (None, 5, 81)
    assert one(spark, E.wrap_cast(lit(-1), "byte"), E.wrap_cast(lit(300), "byte"), E.wrap_cast(lit(40000), "short"), E.wrap_cast(lit(-3.9), "long")) == (255, 44, -25536, -3)
    assert one(spark, E.is_in(lit(NAN), F.array(lit(NAN))), E.is_in(lit(2.0), F.array(lit(2.0))), E.approx_artol(lit(NAN), lit(NAN))) == (0, 1, 1)


def test_missing_values(spark):
    df = vector(spark, [1, 2, None, NAN, INF])
    got = df.select(E.isbad("v"), E.setnantobad("v"), E.setinftobad("v"), E.setnonfinitetobad("v"), E.badmask("v", -1.0), E.isfinite("v")).collect()
    assert [r[0] for r in got] == [0, 0, 1, 0, 0]
    assert same([r[1] for r in got], [1, 2, None, None, INF]) and same([r[2] for r in got], [1, 2, None, NAN, None])
    assert [r[3] for r in got] == [1, 2, None, None, None] and [r[4] for r in got] == [1, 2, -1, -1, -1] and [r[5] for r in got] == [1, 1, 0, 0, 0]
    assert [r[1] for r in sequences.locf(vector(spark, [None, 3, None, 4]), [], ["i0"], "v").select("i0", "locf").orderBy("i0").collect()] == [0, 3, 3, 4]


def test_complex_and_polynomials(spark):
    z = E.csqrt(E.czip(F.lit(-3.0), F.lit(-4.0)))
    up = E.csqrt_up(E.czip(F.lit(-3.0), F.lit(-4.0)))
    assert same(one(spark, E.re(z), E.im(z), E.re(up), E.im(up)), (1, -2, -1, 2))
    assert one(spark, E.polyfromroots(F.array(F.lit(1.0), F.lit(-2.0))))[0] == [1, 1, -2]
    roots = one(spark, S.polyroots(F.array(F.lit(1.0), F.lit(0.0), F.lit(-4.0))))[0]
    assert same([r["re"] for r in roots], [-2, 2])


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(a).cast("double") for a in x])
    assert one(spark, E.cmpvec(v(1, 2, 3), v(3, 2, 1)), E.cmpvec(v(1, None), v(3, 2)), E.eqvec(v(1, None), v(1, 2)), E.eqvec(v(1, 2), v(1, 2))) == (-1, -1, None, 1)
    assert one(spark, E.inner(v(1, None), v(1, 2)), E.crossp(v(1, 0, 0), v(0, 1, 0))) == (None, [0, 0, 1])
    assert math.isnan(one(spark, E.vcos(v(0, 0), v(1, 1)))[0])


def test_special_functions(spark):
    got = one(spark, S.erf(F.lit(0.5)), S.erfc(F.lit(0.5)), S.ndtri(F.lit(0.975)), S.erfi(F.lit(0.5)), S.bessj0(F.lit(2.5)), S.bessj1(F.lit(-2.5)), S.bessy0(F.lit(2.5)), S.bessy1(F.lit(0.3)), S.bessjn(F.lit(10.0), 3), S.bessyn(F.lit(3.0), 2), S.lgamma(F.lit(-0.5))["sign"], S.erf(F.lit(None).cast("double")))
    want = (0.5204998778, 0.4795001222, 1.9599639845, 0.4769362762, -0.0483837765, -0.4970941025, 0.4980703596, -2.2931051384, 0.0583793793, -0.1604003935, -1, None)
    assert all(a == b or abs(a - b) < 1e-7 for a, b in zip(got, want, strict=True))


def test_windows(spark):
    df = vector(spark, [4, None, 7, 9]).withColumn("k", F.lit(1))
    col = lambda d, c: [r[c] for r in d.orderBy("i0").collect()]
    assert col(sequences.cumusumover(df, ["k"], ["i0"], "v"), "cumusum") == [4, None, 11, 20]
    assert col(sequences.diff2(df, ["k"], ["i0"], "v"), "diff2") == [None, 3, 2]
    full = vector(spark, [1, 2, 4, 8, 16]).withColumn("k", F.lit(1))
    assert col(sequences.numdiff(full, ["k"], ["i0"], "v"), "numdiff") == [1, 1, 2, 4, 8]
    assert col(sequences.diffcentred(full, ["k"], ["i0"], "v"), "diffcentred") == [-7, 1.5, 3, 6, -3.5]
    assert col(sequences.conv1d(full, ["k"], "i0", "v", [1, 2, 3]), "conv1d") == [3 * 16 + 2 * 1 + 2, 3 + 4 + 4, 6 + 8 + 8, 12 + 16 + 16, 24 + 32 + 1]
    assert col(sequences.lags(full, ["k"], ["i0"], "v", 1, 2), "lag1") == [1, 2, 4, 8]
    assert {r["i0"]: r["v"] for r in sequences.rotate(full, ["k"], "i0", -1).collect()} == {4: 1, 0: 2, 1: 4, 2: 8, 3: 16}
    for n in range(1, 9):
        x = vector(spark, range(n)).withColumn("k", F.lit(1))
        assert sequences.intover(x, ["k"], "i0", "v").first()["integral"] == pytest.approx((n - 1) ** 2 / 2)


def test_runs(spark):
    df = vector(spark, [5, 5, None, None, 6, 7, 8, 2]).withColumn("k", F.lit(1))
    runs = sequences.rle(df, ["k"], ["i0"], "v")
    assert [(r["len"], r["value"]) for r in runs.orderBy("run").collect()] == [(2, 5), (2, None), (1, 6), (1, 7), (1, 8), (1, 2)]
    assert [r["value"] for r in sequences.rld(runs, ["k"]).orderBy("i0").collect()] == [5, 5, None, None, 6, 7, 8, 2]
    seq = sequences.rleseq(vector(spark, [1, 2, 3, 7, 8, 4], "int").withColumn("k", F.lit(1)), ["k"], ["i0"], "v")
    assert [(r["len"], r["start"]) for r in seq.orderBy("run").collect()] == [(3, 1), (2, 7), (1, 4)]
    assert sorted(r["value"] for r in sequences.rldseq(seq, ["k"]).collect()) == [1, 2, 3, 4, 7, 8]


def test_sets(spark):
    even, three = (spark.createDataFrame([(x,) for x in r], "v long") for r in (range(0, 10, 2), range(0, 10, 3)))
    for op, want in (("AND", [0, 6]), ("OR", [0, 2, 3, 4, 6, 8, 9]), ("XOR", [2, 3, 4, 8, 9])):
        assert sorted(r[0] for r in sets.setops(even, op, three).collect()) == want
    assert len(sets.uniq(vector(spark, [1, 1, NAN, NAN, None]), "v").collect()) == 3
    with pytest.raises(ValueError):
        sets.setops(even, "NOT", three)


def test_histograms(spark):
    df = vector(spark, [-5, 0.5, 1.5, 1.6, 99, None, NAN])
    got = {r["bin"]: r["hist"] for r in histograms.histogram(df, "v", 1.0, 0.0, 4).collect()}
    assert got == {0: 2, 1: 2, 2: 0, 3: 1}
    sums = histograms.indadd(spark.createDataFrame([(1, 2.0), (1, 3.0), (3, None)], "i long, v double"), "v", "i", 5)
    assert {r["i0"]: r["total"] for r in sums.collect()} == {0: 0, 1: 5, 2: 0, 3: None, 4: 0}
    with pytest.raises(Exception, match="out of range"):
        histograms.indadd(spark.createDataFrame([(9, 2.0)], "i long, v double"), "v", "i", 5).collect()


def test_histograms_of_nothing_and_of_nan(spark):
    assert [(r["bin"], r["hist"]) for r in histograms.hist(vector(spark, []), "v").collect()] == [(0, 0)]
    assert sum(r["hist"] for r in histograms.hist(vector(spark, [None, NAN, 1, 2, 5]), "v").collect()) == 3
    two = spark.createDataFrame([(NAN, 1.0), (1.0, NAN), (None, 1.0), (0.5, 0.5)], "a double, b double")
    assert sum(r["hist"] for r in histograms.histogram2d(two, "a", "b", (1.0, 1.0), (0.0, 0.0), (2, 2)).collect()) == 1


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(ranged, "CHUNK", 7)
    monkeypatch.setattr(ranged, "FEW_VALUES", 3)


SCANS = {
    "cumusumover": lambda df, by: sequences.cumusumover(df, by, ["i0"], "v"),
    "cumuprodover": lambda df, by: sequences.cumuprodover(df, by, ["i0"], "v"),
    "locf": lambda df, by: sequences.locf(df, by, ["i0"], "v"),
    "numdiff": lambda df, by: sequences.numdiff(df, by, ["i0"], "v"),
    "diff2": lambda df, by: sequences.diff2(df, by, ["i0"], "v"),
    "diffcentred": lambda df, by: sequences.diffcentred(df, by, ["i0"], "v"),
    "lags": lambda df, by: sequences.lags(df, by, ["i0"], "v", 3, 4),
    "rotate": lambda df, by: sequences.rotate(df, by, "i0", 5),
    "conv1d": lambda df, by: sequences.conv1d(df, by, "i0", "v", [0.5, 0.25, 2.0]),
    "intover": lambda df, by: sequences.intover(df, by, "i0", "v"),
    "qsorti": lambda df, by: sequences.qsorti(df, by, "v", ["i0"]),
    "qsortveci": lambda df, by: sequences.qsortveci(df, by, ["w", "v"], ["i0"]),
    "rle": lambda df, by: sequences.rle(df, by, ["i0"], "w"),
    "rlevec": lambda df, by: sequences.rlevec(df, by, ["i0"], ["w", "u"]),
    "rld": lambda df, by: sequences.rld(sequences.rle(df, by, ["i0"], "w"), by),
    "rleseq": lambda df, by: sequences.rleseq(df, by, ["i0"], "u"),
    "enumvecg": lambda df, by: sequences.enumvecg(df, by, ["w"]),
    "partial": lambda df, by: sequences.partial(df, by, ["i0"], "v", "b"),
    "pctover": lambda df, by: sequences.pctover(df, by, "v", {"a": 0.3, "b": 1.0, "c": -1.0}),
    "stats": lambda df, by: sequences.stats(df, by, "v"),
}


@pytest.mark.parametrize(("name", "n"), [*((name, 50) for name in sorted(SCANS)), *((name, n) for name in ("cumusumover", "diffcentred", "lags", "qsorti", "rle", "rld") for n in (0, 1)), ("pctover", 1), ("stats", 1)])
def test_long_vectors_as_one_group(spark, small_chunks, name, n):
    """Without groups, a vector is scanned in ranges; the result is that of a window over one group."""
    rng = np.random.default_rng(n)
    rows = [(i, None if x == 3 else float(x), int(w), int(u)) for i, (x, w, u) in enumerate(zip(rng.integers(1, 9, n), rng.integers(0, 2, n), np.arange(n) // 3 % 5 + np.arange(n) % 3, strict=True))]
    df = spark.createDataFrame(rows, "i0 long, v double, w int, u int").repartition(3)
    plain = lambda d: sorted(str([f"{x:.6g}" if isinstance(x, float) else x for x in r]) for r in d.collect())
    long, group = SCANS[name](df, []), SCANS[name](df.withColumn("g", F.lit(1)), ["g"])
    assert plain(long) == plain(group.select(long.columns))


def test_no_window_covers_a_vector(spark):
    df = vector(spark, range(20)).withColumn("w", F.col("i0") % 2).withColumn("u", F.col("i0"))
    for name in ("cumusumover", "locf", "numdiff", "qsorti", "rle", "lags"):
        plan = SCANS[name](df, [])._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_search_of_vectors(spark):
    k = spark.createDataFrame([(1, "a"), (1, "c"), (3, "b"), (3, "b")], "x int, y string")
    p = spark.createDataFrame([(0, "z"), (1, "a"), (1, "b"), (3, "b"), (4, "a")], "x int, y string").repartition(4)
    assert {(r["x"], r["y"]): r["found"] for r in search.vsearchvec(k, ["x", "y"], p, ["x", "y"]).collect()} == {(0, "z"): 0, (1, "a"): 0, (1, "b"): 1, (3, "b"): 2, (4, "a"): 3}


def test_resample_of_repeated_places(spark):
    img = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(3) for j in range(3)], "i long, j long, v double")
    asked = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (0.5, 0.5)], "a double, b double")
    assert sorted(r["value"] for r in signal.resample(img, (3, 3), asked, F.col("a"), F.col("b")).collect()) == [5.5, 11, 11]


def test_tiles_of_larger_images(spark, monkeypatch):
    monkeypatch.setattr(signal, "TILE", 4)
    rng = np.random.default_rng(5)
    m, k = rng.random((11, 9)), rng.random((3, 5))
    img = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(11) for j in range(9)], "i long, j long, v double")
    for boundary, mode in (("periodic", "wrap"), ("reflect", "symmetric"), ("replicate", "edge")):
        padded = np.pad(m, ((1, 1), (2, 2)), mode=mode)
        want = {(i, j): sum(k[1 - a, 2 - b] * padded[i + a + 1, j + b + 2] for a in (-1, 0, 1) for b in range(-2, 3)) for i in range(11) for j in range(9)}
        got = {(r["i"], r["j"]): r["v"] for r in signal.conv2d(img, [], (11, 9), k.tolist(), boundary).collect()}
        assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)


def test_bessel_far_out(spark):
    """Large arguments take no memory and agree with the integral where both hold."""
    x = np.array([1e8, -3e12, 999.0, 1001.0, 5.0])
    assert np.abs(S._bessel_j(x, 0)).max() < 1 and np.isfinite(S._bessel_y(np.abs(x), 1)).all()
    at = np.array([400.0, 700.0, 990.0])
    for n in (0, 1, 3):
        assert np.allclose(S._bessel_j(at, n), S._expansion(at, n)[0], atol=1e-9) and np.allclose(S._bessel_y(at, n), S._expansion(at, n)[1], atol=1e-7)
    assert np.isnan(one(spark, S.bessj0(F.lit(NAN)))[0]) and one(spark, S.bessj0(F.lit(INF)), S.erf(F.lit(None).cast("double")), S.ndtri(F.lit(1.0))) == (0, None, INF)


def test_special_functions_against_the_library():
    x = np.concatenate([np.linspace(-6, 6, 241), [-30.0, 0.0, 30.0]])
    assert np.allclose(S._erf(x), [math.erf(a) for a in x], rtol=1e-13, atol=1e-15) and np.allclose(S._erfc(x), [math.erfc(a) for a in x], rtol=1e-10)
    p = np.concatenate([np.linspace(0.001, 0.999, 101), [1e-12, 1 - 1e-12]])
    assert np.allclose(S._normal_quantile(p), [NormalDist().inv_cdf(a) for a in p], rtol=1e-9, atol=1e-12)
    g = np.concatenate([np.linspace(0.05, 60, 500), [-0.5, -2.3, -7.9, 1e6]])
    assert np.allclose(S._log_gamma(g), [math.lgamma(a) for a in g], rtol=1e-11, atol=1e-12)


def test_selection(spark):
    df = generate.sequence(spark, [10, 4])
    cut = selection.slice_dim(selection.slice_dim(df, "i0", 1, 3, 2), "i1", 1, -2, size=4)
    assert sorted((r["i0"], r["i1"], r["v"]) for r in cut.collect()) == [(0, 0, 11), (0, 1, 21), (1, 0, 13), (1, 1, 23)]
    assert [r["v"] for r in selection.dice(vector(spark, [5, 6, 7]), "i0", [2, 0, 2]).orderBy("i0").collect()] == [7, 5, 7]
    placed = selection.insert(generate.zeroes(spark, [3, 3]), generate.ones(spark, [2, 2]), ["i0", "i1"], "v", [1, 1])
    assert {(r["i0"], r["i1"]) for r in placed.where("v = 1").collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    tri = selection.squaretotri(generate.sequence(spark, [3, 3]), "i0", "i1", "v").orderBy("i0").collect()
    assert [(r["i0"], r["v"]) for r in tri] == [(0, 0), (1, 3), (2, 4), (3, 6), (4, 7), (5, 8)]
    with pytest.raises(Exception, match="out of range"):
        selection.index_nd(vector(spark, [1]), ["i0"], "v", vector(spark, [3]), [F.col("v")], [1]).collect()
    back = selection.splitdim(selection.clump(df, "i0", "i1", 10, "f"), "f", 10, "i0", "i1")
    assert sorted(map(str, back.select("i0", "i1", "v").collect())) == sorted(map(str, df.collect()))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_search(spark, by):
    rng = np.random.default_rng(0)
    knots = np.sort(rng.integers(0, 60, 80)).astype(float)
    probes = np.concatenate([rng.integers(-3, 64, 150).astype(float), rng.random(50) * 60])
    k = spark.createDataFrame([(1, float(x)) for x in knots], "k int, x double")
    p = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(probes)], "k int, id int, v double").repartition(5)
    left, right = np.searchsorted(knots, probes), np.searchsorted(knots, probes, side="right")
    want = {"insert_leftmost": left, "insert_rightmost": right, "sample": np.minimum(left, 79), "bin_inclusive": right - 1, "bin_exclusive": left - 1}
    for mode, w in want.items():
        got = {r["id"]: r["found"] for r in search.vsearch(k, "x", p, "v", mode, by).collect()}
        assert got == dict(enumerate(w.tolist()))
    got = {r["id"]: r["found"] for r in search.vsearch(k, "x", p, "v", "match", by).collect()}
    assert all(knots[got[i]] == v if v in knots else got[i] == -(left[i] + 1) for i, v in enumerate(probes))


@pytest.mark.parametrize("by", [[], ["k"]])
def test_interpolate(spark, by):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0]
    k = spark.createDataFrame([(1, a, 3 * a * (a - 2)) for a in x], "k int, x double, y double")
    p = spark.createDataFrame([(1, a - 0.5) for a in x] + [(1, 11.0)], "k int, v double")
    got = search.interpolate(k, "x", "y", p, "v", by).orderBy("v").collect()
    assert same([r["yi"] for r in got], [-4.5, -1.5, 4.5, 16.5, 34.5, 58.5, 126, 216, 288]) and [r["err"] for r in got] == [1, 0, 0, 0, 0, 0, 0, 0, 1]


def test_cubic_interpolation(spark):
    x = np.array([0.0, 1, 2.5, 3, 5])
    k = spark.createDataFrame([(1, float(a), float(a**3)) for a in x] + [(2, 1.0, 1.0)], "k int, x double, y double")
    p = spark.createDataFrame([(1, 0.7), (1, 4.0), (2, 1.0), (3, 1.0)], "k int, v double")
    got = {(r["k"], r["v"]): (r["value"], r["slope"]) for r in search.cubic_interpolate(k, ["k"], "x", "y", p, "v", "spline").collect()}
    assert same(got[1, 0.7], (0.343, 1.47)) and same(got[1, 4.0], (64, 48)) and got[2, 1.0] == (None, None) == got[3, 1.0]
    assert search.integrate(k, ["k"], "x", "y", 0.0, 4.0, "spline").where("k = 1").first()["integral"] == pytest.approx(64)
    d = search.pchip_slopes(x, np.array([0.0, 1, 1, 2, 2]))
    assert d[1] == d[2] == d[3] == d[4] == 0


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((7, 9)), rng.random((9, 5))
    cells = lambda m: spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")
    for f in (linalg.matmult, lambda x, y: linalg.block_matmult(x, y, 4)):
        got = {(r["i"], r["j"]): r["v"] for r in f(cells(a), cells(b)).collect()}
        assert set(got) == {(i, j) for i in range(7) for j in range(5)} and all(v == pytest.approx((a @ b)[k]) for k, v in got.items())
    holed = cells(a).withColumn("v", F.when((F.col("i") != 2) | (F.col("j") != 3), F.col("v")))
    got = {(r["i"], r["j"]): r["v"] for r in linalg.block_matmult(holed, cells(b), 4).collect()}
    assert {k for k, v in got.items() if v is None} == {(2, j) for j in range(5)}
    assert linalg.block_matmult(holed.where("false"), cells(b)).collect() == []
    gram = spark.createDataFrame([([1.0, INF],), ([2.0, 1.0],)], "x array<double>")
    assert {(r["i"], r["j"]): r["v"] for r in linalg.gram(gram, "x").collect()} == {(0, 0): 5, (0, 1): INF, (1, 0): INF, (1, 1): INF}
    gap = gram.unionAll(spark.createDataFrame([([None, 1.0],)], "x array<double>"))
    assert {(r["i"], r["j"]) for r in linalg.gram(gap, "x").collect() if r["v"] is None} == {(0, 0), (0, 1), (1, 0)}
    m = rng.random((4, 4))
    df = spark.createDataFrame([(m.tolist(), [1.0, 2.0, 3.0, 4.0]), ([[1.0, 1.0], [1.0, 1.0]], [1.0, 1.0]), (None, None)], "m array<array<double>>, b array<double>")
    got = df.select(linalg.inv(F.col("m")), linalg.det(F.col("m")), linalg.solve(F.col("m"), F.col("b")), linalg.lu_decomp(F.col("m")), linalg.svd(F.col("m"))["s"], linalg.eigens_sym(F.transform("m", lambda r: r))["values"]).collect()
    assert np.allclose(got[0][0], np.linalg.inv(m)) and got[0][1] == pytest.approx(np.linalg.det(m)) and np.allclose(got[0][2], np.linalg.solve(m, [1, 2, 3, 4]))
    lu = np.array(got[0][3]["lu"])
    assert np.allclose((np.tril(lu, -1) + np.eye(4)) @ np.triu(lu), m[got[0][3]["perm"]]) and np.allclose(got[0][4], np.linalg.svd(m)[1])
    assert got[1][0] is None and got[2][1] is None
    assert linalg.trace(cells(m)).first()[0] == pytest.approx(np.trace(m))
    assert linalg.kroneckerproduct(cells(a), cells(b), 9, 5).count() == 7 * 9 * 9 * 5


def test_tall_matrices(spark):
    rng = np.random.default_rng(8)
    x = rng.random((60, 4))
    df = spark.createDataFrame([(i, row.tolist(), float(row @ [1, 2, 3, 4])) for i, row in enumerate(x)], "i int, x array<double>, y double").repartition(3)
    values, turned = linalg.svd_tall(df, "x")
    u = np.array([r["u"] for r in turned.orderBy("i").collect()])
    assert np.allclose(values, np.linalg.svd(x)[1]) and np.allclose(u.T @ u, np.eye(4)) and np.allclose(linalg.solve_tall(df, "x", "y"), [1, 2, 3, 4])


def test_fourier(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 8):
        x, k = rng.random(n), rng.random(min(3, n))
        df = spark.createDataFrame([(x.tolist(), k.tolist())], "x array<double>, k array<double>")
        zero = F.transform("x", lambda v: v * 0)
        row = df.select(signal.fft(F.col("x"), zero).alias("z"), signal.realfft(F.col("x")).alias("r"), signal.fftconvolve(F.col("x"), F.col("k")).alias("c")).select("z.*", "r", "c", signal.realifft(F.col("r")).alias("back")).first()
        assert np.allclose(np.array(row["re"]) + 1j * np.array(row["im"]), np.fft.fft(x)) and np.allclose(row["back"], x)
        assert np.allclose(row["c"], [sum(k[j] * x[(i - j) % n] for j in range(len(k))) for i in range(n)])


def image(spark, m):
    return spark.createDataFrame([(i, j, None if m[i][j] is None else float(m[i][j])) for i in range(len(m)) for j in range(len(m[0]))], "i long, j long, v double")


def back(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["i"], r["j"]] = r[name] if r[name] is not None else np.nan
    return out


def test_images(spark):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 9, (6, 5)).astype(float)
    img, k = image(spark, m.tolist()), rng.random((3, 3))
    want = sum(k[a, b] * np.roll(m, (a - 1, b - 1), (0, 1)) for a in range(3) for b in range(3))
    assert np.allclose(back(signal.conv2d(img, [], (6, 5), k.tolist()), (6, 5)), want)
    padded = np.pad(m, 1, mode="edge")
    med = [[np.median(padded[i : i + 3, j : j + 3]) for j in range(5)] for i in range(6)]
    assert np.allclose(back(signal.med2d(img, [], (6, 5), 3, 3, "replicate"), (6, 5)), med)
    box = m.copy()
    box[1:5, 1:4] = [[m[i - 1 : i + 2, j - 1 : j + 2].mean() for j in range(1, 4)] for i in range(1, 5)]
    assert np.allclose(back(signal.box2d(img, [], (6, 5), 3, 3), (6, 5)), box)
    holes = [[1, None, 3], [4, None, 6]]
    assert np.allclose(back(signal.patch2d(image(spark, holes), [], (2, 3)), (2, 3)), [[1, 3.5, 3], [4, 3.5, 6]])
    assert np.allclose(back(signal.rebin(img, [], 2, 5), (3, 1)), m.reshape(3, 2, 5).mean((1, 2))[:, None])
    assert np.allclose(back(signal.rot2d(img, (6, 5), 0.0), (6, 5)), m)
    mask = [[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]]
    assert back(signal.label_components(image(spark, mask), (4, 4), 8), (4, 4), "label").tolist() == [[1, 0, 0, 2], [0, 1, 0, 2], [0, 0, 0, 0], [3, 3, 0, 0]]
    assert back(signal.label_components(image(spark, mask), (4, 4), 4), (4, 4), "label").max() == 4
    top = signal.max2d_ind(img, []).first()
    assert top["v"] == m.max() and m[top["i"], top["j"]] == m.max()
    fill = back(signal.polyfill(image(spark, np.zeros((6, 6)).tolist()), [(0.5, 0.5), (0.5, 3.5), (3.5, 3.5), (3.5, 0.5)], 7.0), (6, 6))
    assert (fill[1:4, 1:4] == 7).all() and fill.sum() == 63


def test_warp(spark):
    pts = spark.createDataFrame([(2 * u + v * 0.5 + 1, v - 0.25 * u * v, float(u), float(v)) for u in range(4) for v in range(4)], "x double, y double, u double, v double")
    fit = signal.fitwarp2d(pts, "x", "y", "u", "v", 2)
    got = pts.select("x", "y", signal.warp_columns(F.col("u"), F.col("v"), fit["x"], 2), signal.warp_columns(F.col("u"), F.col("v"), fit["y"], 2)).collect()
    assert all(r[0] == pytest.approx(r[2]) and r[1] == pytest.approx(r[3]) for r in got)


T = transforms
ROUND_TRIPS = [T.t_linear(rot=30, pre=[1, 2], post=[3, 4], scale=2.0), T.t_radial((0.1, 0.2)), T.t_quadratic(0.3), T.t_mercator(), T.t_sinusoidal(), T.t_sin_lat(), T.t_orthographic(), T.t_stereographic(), T.t_gnomonic(), T.t_az_eqd(), T.t_az_eqa(), T.t_hammer(), T.t_conic(0.3, 0.8), T.t_albers(0.3, 0.8), T.t_lambert(0.3, 0.8), T.t_lambert(0.5, 0.5), T.t_rot_sphere(0.4, 0.3), T.t_rot(40) @ T.t_offset([1, 2]), T.t_scale(3) ** -2, T.t_fits({"CRPIX1": 3, "CRVAL1": 10.0, "CDELT1": 0.5, "CROTA2": 20})]


@pytest.mark.parametrize("t", ROUND_TRIPS, ids=lambda t: t.name)
def test_transforms(spark, t):
    df = spark.createDataFrame([(0.1, 0.2), (-0.7, 0.5), (0.9, -0.4), (0.001, 0.7)], "x double, y double")
    for r in df.select("x", "y", *t.apply(F.col("x"), F.col("y"))).toDF("x", "y", "a", "b").select("x", "y", *t.invert(F.col("a"), F.col("b"))).collect():
        assert r[2] == pytest.approx(r[0]) and r[3] == pytest.approx(r[1])


def test_generators(spark):
    assert [r["v"] for r in generate.fibonacci(spark, 10).orderBy("i0").collect()] == [1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    assert generate.identity(spark, 3).agg(F.sum("v")).first()[0] == 3
    assert generate.rvals(spark, [3, 3]).where("i0 = 1 AND i1 = 1").first()["v"] == 0
    assert same([r["v"] for r in generate.axislogvals(spark, [3], 0, 1.0, 100.0).orderBy("i0").collect()], [1, 10, 100])
    assert generate.meshgrid([spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double")] * 2).count() == 4


def test_scratch_tables_go(spark):
    with shared.scratch(spark) as held:
        kept = shared.materialize(spark.range(3), "kept")
        mine = held.pop()
        gone = shared.materialize(spark.range(2), "gone")
        path = held[0]
        assert gone.count() == 2
    assert kept.count() == 3 and Path(mine).exists() and not Path(path).exists()
    assert shared.materialize(spark.range(1), "after").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 150)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100, 200: 150}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_partitioning_does_not_matter(spark, parts):
    df = spark.createDataFrame([(i % 5, i, float(i * 37 % 101)) for i in range(300)], "k int, i0 long, v double").repartition(parts)
    got = sequences.statsover(df, ["k"], "v").orderBy("k").collect()
    want = {k: np.array([i * 37 % 101 for i in range(k, 300, 5)], float) for k in range(5)}
    assert all(r["avg"] == pytest.approx(want[r["k"]].mean()) and r["prms"] == pytest.approx(want[r["k"]].std(ddof=1)) for r in got)


def test_whichover_keeps_every_index(spark):
    cells = spark.createDataFrame([(g, i, i % 5 != 1) for g, n in ((0, 12), (1, 3)) for i in range(n)], "g long, i0 long, m boolean")
    got = {r["g"]: r["inds"] for r in selection.whichover(cells, ["g"], F.col("m"), "i0").collect()}
    assert got == {0: [0, 2, 3, 4, 5, 7, 8, 9, 10, -1, -1, -1], 1: [0, 2, -1]}
    assert all(len(r["inds"]) == 12 for r in selection.whichover(cells, ["g"], F.col("m"), "i0", 12).collect())
    with pytest.raises(Exception, match="more cells"):
        selection.whichover(cells, ["g"], F.col("m"), "i0", 7).collect()

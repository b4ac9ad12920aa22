"""Lines of text files by number, and convolution of long vectors by tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.operators import sequences, signal
from cellgrid.sources import text
from tests.test_sources import put


def picked(spark, path, lines, **options):
    return [tuple(r)[1:] for r in text.rcols(spark, path, ["x", "y"], lines=lines, **options).orderBy("nth").collect()]


def test_lines(spark, tmp_path):
    path = put(tmp_path / "a.txt", "1 2\n# comment line\n3 4\n-5 6\n7 8\n")
    assert picked(spark, path, "-2:0") == [(-5, 6), (3, 4), (1, 2)]
    assert picked(spark, path, "1:3") == [(3, 4), (-5, 6)] and picked(spark, path, "3:1") == [(-5, 6), (3, 4)]
    assert picked(spark, path, "2:") == picked(spark, path, "-3:-1") == [(3, 4), (-5, 6), (7, 8)]
    assert picked(spark, path, "-1:-2") == [(7, 8), (-5, 6)]
    assert picked(spark, path, "::2") == [(1, 2), (-5, 6)] and picked(spark, path, "2::2") == [(3, 4), (7, 8)]
    assert picked(spark, path, "-1:0:2") == [(-5, 6), (1, 2)]  # every second from the start, then turned
    assert picked(spark, path, "9:") == [] and picked(spark, put(tmp_path / "none", ""), ":") == []
    for bad in ("x", "1", "1:2:0", "1:2:-1"):
        with pytest.raises(ValueError, match="no line numbers"):
            picked(spark, path, bad)


def test_names_in_the_first_line(spark, tmp_path):
    path = put(tmp_path / "a.txt", "time  height\n1 2\n3 4\n")
    assert text.column_ids(spark, path) == ["time", "height"]
    assert sorted(map(tuple, text.rcols(spark, path, text.column_ids(spark, path), colids=True).collect())) == [(1, 2), (3, 4)]
    assert picked(spark, path, "0:0", colids=True) == [(1, 2)]
    assert text.column_ids(spark, put(tmp_path / "none", "")) == []


def test_lines_of_many_blocks(spark, tmp_path):
    """A file that is read in blocks of 100 bytes, with another beside it."""
    put(tmp_path / "a.txt", "".join(f"{k} {k % 7}\n" for k in range(1000)))
    put(tmp_path / "b.txt", "".join(f"{-k} 0\n" for k in range(10)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(f"{tmp_path}/a.txt").rdd.getNumPartitions() > 50
        got = picked(spark, f"{tmp_path}/a.txt", "-3:100:50")
        assert got == [(k, k % 7) for k in range(100, 998, 50)][::-1]
        assert sorted(picked(spark, str(tmp_path), "-2:-1")) == [(-9, 0), (-8, 0), (998, 4), (999, 5)]
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before, strict=True):
            spark.conf.set(f"spark.sql.files.{name}", value)


def convolved(x, kernel, shift=0):
    n = len(x)
    return np.array([sum(h * x[(t + shift - k) % n] for k, h in enumerate(kernel)) for t in range(n)])


@pytest.mark.parametrize("n, taps, tile", [(50, 5, 8), (50, 5, 1), (20, 20, 1), (7, 3, 64), (6, 15, 1), (1, 1, 1), (64, 16, 64), (65, 16, 64)])
@pytest.mark.parametrize("centred", [False, True])
def test_convolution_by_tiles(spark, n, taps, tile, centred):
    rng = np.random.default_rng(n)
    x, kernel = rng.normal(size=n), rng.normal(size=taps)
    cells = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)] + [(None, n - 1, 2.0)], "g string, i long, v double")
    rows = signal.fftconvolve_long(cells, ["g"], "i", "v", n, kernel.tolist(), centred, tile).collect()
    got = {(r["g"], r["i"]): r["v"] for r in rows}
    shift = (taps - 1) // 2 if centred else 0
    assert len(got) == len(rows) == 2 * n
    assert np.allclose([got["a", k] for k in range(n)], convolved(x, kernel, shift))
    assert np.allclose([got[None, k] for k in range(n)], convolved(np.where(np.arange(n) == n - 1, 2.0, 0), kernel, shift), atol=1e-12)
    if centred and taps <= n:
        plain = {r["i"]: r["conv1d"] for r in sequences.conv1d(cells.where("g = 'a'"), ["g"], "i", "v", kernel.tolist()).collect()}
        assert np.allclose([got["a", k] for k in range(n)], [plain[k] for k in range(n)])


def test_convolution_of_odd_cells(spark):
    values = [1.0, None, 2.0, 3.0, float("inf"), 4.0, 5.0, 6.0, 7.0, 8.0, float("nan"), 9.0]
    cells = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    got = [r["v"] for r in signal.fftconvolve_long(cells, [], "i", "v", 12, [1.0, 1.0], tile=4).orderBy("i").collect()]
    want = [10.0, None, None, 5.0, "x", "x", 9.0, 11.0, 13.0, 15.0, "x", "x"]
    assert [None if g is None else "x" if g != g else round(g, 9) for g in got] == want
    for bad in ([(12, 1.0)], [(-1, 1.0)], [(None, 1.0)], [(3, 1.0), (3, 2.0)]):
        with pytest.raises(Exception, match="beyond a vector of 12|there twice"):
            signal.fftconvolve_long(spark.createDataFrame(bad, "i long, v double"), [], "i", "v", 12, [1.0]).collect()
    assert signal.fftconvolve_long(cells.where("false"), [], "i", "v", 12, [1.0]).count() == 0


def test_convolution_with_a_kernel_of_cells(spark):
    x, kernel = np.arange(24.0) % 7, np.where(np.arange(24) < 15, 1 / (1 + np.arange(24)), 0)
    cells = spark.createDataFrame([(g, k, float(v) * g) for g in (1, 2) for k, v in enumerate(x)], "g int, i long, v double")
    h = spark.createDataFrame([(k, float(v)) for k, v in enumerate(kernel)], "i long, v double")
    got = signal.fftconvolve_cells(cells, h, ["g"], "i", 4, 6).orderBy("g", "i").select(F.col("v")).collect()
    assert np.allclose([r[0] for r in got], np.concatenate([convolved(x, kernel), 2 * convolved(x, kernel)]))

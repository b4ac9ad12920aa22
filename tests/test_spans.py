"""Files read in ranges: the same cells for any number of them, and errors for files that end too early."""

import numpy as np
import pytest

from cellgrid.sources import binary, spans
from tests.test_sources import put


def cells(df):
    rows = df.collect()
    got = {(r["unit"], *r["i"]): r["v"] for r in rows}
    assert len(got) == len(rows)
    return got


def same(got, data, unit=0):
    want = {(unit, *place[::-1]): None if v != v else v for place, v in np.ndenumerate(data)}
    assert got == want


@pytest.mark.parametrize("per", [1, 7, None])
def test_raw(spark, tmp_path, per):
    a, b = np.arange(24, dtype="<i2").reshape(2, 3, 4), np.array([0.5, np.nan, 1e300])
    path = put(tmp_path / "a b.raw", b"head" + a.tobytes() + b.astype(">f8").tobytes())
    chunks = [{"type": "short", "dims": [4, 3, 2], "offset": 4}, {"type": "byte", "dims": [0]}, {"type": "double", "dims": [3], "swap": True}]
    got = cells(spans.raw_cells(spark, path, chunks, per))
    same({k: v for k, v in got.items() if k[0] == 0}, a)
    same({k: v for k, v in got.items() if k[0] == 2}, b, 2)
    assert {k[0] for k in got} == {0, 2}


def test_a_file_that_ends_early(spark, tmp_path):
    path = put(tmp_path / "x.raw", bytes(11))
    with pytest.raises(Exception, match="ends within its data"):
        spans.raw_cells(spark, path, [{"type": "long", "dims": [3]}]).collect()


@pytest.mark.parametrize("per", [3, None])
def test_fits_image(spark, tmp_path, per):
    data = np.arange(220, dtype="i2").reshape(20, 11)
    more = np.where(data % 7 == 0, np.nan, data / 4).astype("f4")
    second = binary.fits_unit({"XTENSION": "IMAGE", "BITPIX": -32, "NAXIS": 2, "NAXIS1": 11, "NAXIS2": 20, "BSCALE": 2.0, "BZERO": 1.0}, more.astype(">f4").tobytes())
    path = put(tmp_path / "x.fits", binary.fits_bytes(data, {"BLANK": 7}) + second)
    got = cells(spans.fits_cells(spark, path, per=per))
    same({k: v for k, v in got.items() if k[0] == 0}, np.where(data == 7, np.nan, data))
    same({k: v for k, v in got.items() if k[0] == 1}, more.astype(float) * 2 + 1, 1)
    plain = {(r["unit"], r["v"]) for r in spans.fits_cells(spark, path, bscale=False).where("unit = 1").collect()}
    assert (1, 0.25) in plain


@pytest.mark.parametrize("tile", [None, [5, 3], [11, 20], [40, 40]])
@pytest.mark.parametrize("kind", ["u1", "i2", "i4"])
def test_tiled_image(spark, tmp_path, tile, kind):
    data = (np.arange(220) * 3 % 101).reshape(20, 11).astype(kind)
    data[4:9] = np.random.default_rng(0).integers(np.iinfo(kind).min, np.iinfo(kind).max, (5, 11))  # not to be compressed
    path = put(tmp_path / "x.fits", binary.fits_bytes(np.zeros(3, "u1")) + spans.tiled_fits_bytes(data, tile)[binary.FITS_BLOCK :])
    same(cells(spans.fits_tiled_cells(spark, path, per=2)), data.astype(float), 1)


def test_tiled_image_scaled_and_blank(spark, tmp_path):
    data = np.arange(24, dtype="i4").reshape(2, 3, 4)
    path = put(tmp_path / "x.fits", spans.tiled_fits_bytes(data, [4, 3, 1], {"ZBLANK": 5, "ZSCALE": 0.5, "ZZERO": 1.0, "BZERO": 100.0}))
    same(cells(spans.fits_tiled_cells(spark, path)), np.where(data == 5, np.nan, data * 0.5 + 101), 1)
    other = put(tmp_path / "y.fits", (tmp_path / "x.fits").read_bytes().replace(b"'RICE_1'", b"'GZIP_1'"))
    with pytest.raises(Exception, match="compressed by GZIP_1"):
        spans.fits_tiled_cells(spark, other).collect()


def test_table_in_spans(spark, tmp_path):
    rows = np.zeros(50, np.dtype([("k", ">i4"), ("name", "S3"), ("xy", ">f8", 2)]))
    rows["k"], rows["name"], rows["xy"] = np.arange(50), [f"n{k}" for k in range(50)], np.arange(100).reshape(50, 2) / 8
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": 23, "NAXIS2": 50, "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": 3, "TFORM1": "J", "TTYPE1": "k", "TFORM2": "3A", "TTYPE2": "name", "TFORM3": "2D"}
    path = put(tmp_path / "t.fits", binary.fits_bytes(np.zeros(3, "u1")) + binary.fits_unit(cards, rows.tobytes()))
    for per in (1, 9, None):
        got = spans.rfits_table(spark, path, per).orderBy("row").collect()
        assert [(r["row"], r["fields"]["k"], r["fields"]["name"], r["fields"]["COL_3"]) for r in got] == [(k, [str(k)], [f"n{k}"], [str(k / 4), str(k / 4 + 0.125)]) for k in range(50)]


def test_mesh_in_spans(spark, tmp_path):
    corners = np.arange(90.0).reshape(10, 3, 3)
    path = put(tmp_path / "a.stl", binary.stl_bytes(corners))
    put(tmp_path / "b.stl", "solid\n" + "".join("vertex %g %g %g\n" % tuple(c) for c in corners.reshape(-1, 3)) + "endsolid\n")
    want = {(f, c, *corners[f, c]) for f in range(10) for c in range(3)}
    for per in (1, 4, None):
        got = spans.rstl(spark, str(tmp_path), per).collect()
        for name in "ab":
            assert {tuple(r)[1:] for r in got if r["file"].endswith(f"{name}.stl")} == want
        assert len(got) == 60
    assert spans.rstl(spark, path).count() == 30

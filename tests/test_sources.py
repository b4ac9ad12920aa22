"""Readers and writers by round trips, and streaming forms."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.sources import binary, spans, text
from cellgrid.streaming import running


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_text_columns(spark, tmp_path):
    path = put(tmp_path / "a.txt", "# c\n1 2\n\n2 33 FOO\n3 7\n4 9 FOO\n5 66\n")
    assert sorted(map(tuple, text.rcols(spark, path, ["x", "y"]).collect())) == [(1, 2), (2, 33), (3, 7), (4, 9), (5, 66)]
    assert sorted(map(tuple, text.rcols(spark, path, ["x", "y"], include="FOO").collect())) == [(2, 33), (4, 9)]
    path = put(tmp_path / "b.csv", "1,6,11\n2,7,\n3,8,13\n4,,14\n5,10,15\n")
    got = sorted(map(tuple, text.rcols(spark, path, ["a", "b", "c"], sep=",", undef=-1.0).collect()))
    assert got == [(1, 6, 11), (2, 7, -1), (3, 8, 13), (4, -1, 14), (5, 10, 15)]
    path = put(tmp_path / "c.txt", 'foo"1" -2-\nbar\nfoo"2" -33-\n')
    assert sorted(map(tuple, text.rgrep(spark, path, r'foo"(\d+)" -(\d+)-', ["a", "b"]).collect())) == [(1, 2), (2, 33)]
    assert sorted(map(tuple, text.rasc(spark, put(tmp_path / "d", "1 x\n 2.5")).collect())) == [(0, 1), (1, 0), (2.5, 0)]
    df = spark.createDataFrame([(1, 2.5), (3, None)], "a int, b double")
    text.wcols(df, ["a", "b"], f"{tmp_path}/out", sep=",")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["1,2.5", "3,"]
    assert text.swcols(df.limit(1), ["a"], "%03d").first()[0] == "001"


def test_raw_and_flex(spark, tmp_path):
    a, b = np.arange(12, dtype="<i2"), np.linspace(0, 1, 5)
    path = put(tmp_path / "f", a.tobytes() + b.tobytes())
    chunks = binary.parse_flexhdr("# two\nshort 2 3 4\ndouble 1 5\n")
    assert binary.parse_flexhdr(binary.write_flexhdr(chunks)) == chunks
    rows = binary.readflex(spark, path, chunks).collect()
    assert [r["shape"] for r in rows] == [[3, 4], [5]] and rows[0]["data"] == a.tolist() and np.allclose(rows[1]["data"], b)
    raw = binary.readraw(spark, put(tmp_path / "g", a.astype(">i2").tobytes()), "short", [12], swap=True)
    assert raw.first()["data"] == a.tolist() and bytes(raw.select(binary.raw_bytes(F.col("data"), "short")).first()[0]) == a.tobytes()
    cells = binary.cells(binary.readflex(spark, path, chunks[:1])).collect()
    assert {tuple(r["i"]): r["v"] for r in cells} == {(i % 3, i // 3): i for i in range(12)}


@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "f4", "f8"])
def test_fits(spark, tmp_path, kind):
    data = np.arange(220).reshape(20, 11).astype(kind)
    path = put(tmp_path / "x.fits", binary.fits_bytes(data, {"BLANK": 7, "name": "it is"} if kind[0] != "f" else {"bscale": 2.0}))
    row = binary.rfits(spark, path).first()
    want = [None if kind[0] != "f" and v == 7 else v * (2 if kind[0] == "f" else 1) for v in data.ravel().tolist()]
    assert row["shape"] == [11, 20] and row["data"] == want
    assert binary.rfitshdr(spark, path).first()["header"]["NAXIS1"] == "11"


def test_fits_table(spark, tmp_path):
    empty = binary.fits_bytes(np.zeros((0,), "u1").reshape(0))
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", "NAXIS1  = 9", "NAXIS2  = 2", "PCOUNT  = 0", "GCOUNT  = 1", "TFIELDS = 3", "TFORM1  = 'J'", "TTYPE1  = 'FOO'", "TFORM2  = '2I'", "TTYPE2  = 'FOO'", "TFORM3  = '1A'", "END"]
    head = "".join(f"{c:<80}" for c in cards)
    body = struct.pack(">ihhc", 1, 2, 3, b"x") + struct.pack(">ihhc", -4, 5, 6, b"y")
    path = put(tmp_path / "t.fits", empty + head.ljust(2880).encode() + body.ljust(2880, b"\0"))
    rows = spans.rfits_table(spark, path).orderBy("row").collect()
    assert [r["fields"] for r in rows] == [{"FOO": ["1"], "FOO_1": ["2", "3"], "COL_3": ["x"]}, {"FOO": ["-4"], "FOO_1": ["5", "6"], "COL_3": ["y"]}]


def test_pnm_and_stl(spark, tmp_path):
    grey = np.arange(6, dtype=np.uint8).reshape(2, 3)
    for k, data in enumerate((binary.pnm_bytes(grey), binary.pnm_bytes(grey, raw=False), b"P2\n# c\n3 2 255\n0 1 2 3 4 5\n")):
        row = binary.rpnm(spark, put(tmp_path / f"{k}.pgm", data)).first()
        assert row["shape"] == [3, 2] and row["data"] == grey.ravel().tolist()
    bits = binary.rpnm(spark, put(tmp_path / "b.pbm", b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))).first()
    assert bits["data"] == [0, 1, 0, 1, 0, 1]
    faces = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[1, 0, 0], [1, 1, 0], [0, 1, 0]]], float)
    path = put(tmp_path / "m.stl", binary.stl_bytes(faces))
    vertices, index = binary.mesh_vertices(spans.rstl(spark, path))
    assert vertices.count() == 4 and index.count() == 6
    files = spark.read.format("binaryFile").load(f"{tmp_path}/0.pgm")
    assert files.select(binary.imageformat(F.col("content"))).first()[0] == "PNM"


def test_streaming(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(2):
        events.where(f"event_id % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def drain(frame, name):
        q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sums = drain(running.running_sum(stream(), "user_id", "ts", "value"), "sums")
    last = {r["user_id"]: r["t"] for r in events.groupBy("user_id").agg(F.sum("value").alias("t")).collect()}
    most = {}
    for r in sums.collect():
        most.setdefault(r["user_id"], []).append(r["cumusum"])
    assert all(any(abs(x - last[u]) < 1e-6 for x in v) for u, v in most.items()) and sums.count() == events.count()
    stats = running.windowed_stats(stream(), "ts", ["event_type"], "value", "1 day", "3650 days")
    assert stats.isStreaming and running.windowed_histogram(stream(), "ts", "value", 10.0, 0.0, 5).isStreaming
    whole = running.windowed_stats(events, "ts", ["event_type"], "value", "1 day")
    assert whole.agg(F.sum("n")).first()[0] == events.count()

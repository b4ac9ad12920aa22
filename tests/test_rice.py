"""Rice coding by round trips and by streams whose bytes are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrid.functions import rice

# A stream of 64 bytes and the samples it stands for.
STREAM = bytes([126, 48, 24, 0, 96, 48, 14, 179, 32, 54, 219, 109, 147, 85, 96, 91, 91, 126, 206, 112])
SAMPLES = [
    126, 122, 122, 128, 128, 124, 124, 128, 128, 128, 127, 126, 126, 127, 127, 128, 124, 124, 123, 123, 122, 122, 121, 121, 120, 120, 119, 119, 118, 118, 117, 117,
    118, 118, 117, 116, 115, 114, 113, 113, 116, 115, 115, 114, 114, 113, 112, 112, 111, 111, 110, 110, 110, 110, 110, 110, 109, 109, 110, 110, 110, 111, 111, 111,
]


def test_known_stream():
    assert rice.decode([STREAM], 64, "u1")[0].tolist() == SAMPLES
    assert rice.encode(np.array([SAMPLES], "u1")) == [STREAM]


@pytest.mark.parametrize("kind", ["u1", "i2", "u2", "i4"])
@pytest.mark.parametrize("n", [1, 31, 32, 33, 100])
def test_round_trips(kind, n):
    rng, info = np.random.default_rng(n), np.iinfo(kind)
    noise = rng.integers(info.min, info.max, (4, n), endpoint=True)
    calm = np.clip(np.cumsum(rng.integers(-2, 3, (4, n)), axis=1) + 20, 0, 100)
    edges = np.where(np.arange(n) % 2, info.min, info.max) * np.ones((2, 1), int)
    jump = np.where(np.arange(n) == n // 2, info.max, 5)[None]
    x = np.concatenate([noise, calm, edges, jump, np.full((1, n), 7)]).astype(kind)
    for block in (16, 32):
        streams = rice.encode(x, block)
        assert (rice.decode(streams, n, kind, block) == x).all()
        assert [rice.encode(row[None], block)[0] for row in x] == streams
    assert len(streams[-1]) == -(-(8 * x.itemsize + -(-n // 32) * rice.CODE_BITS[x.itemsize]) // 8)


def test_streams_that_end_early():
    for cut in (0, 1, 10, len(STREAM) - 1):
        with pytest.raises(ValueError, match="ends before"):
            rice.decode([STREAM[:cut], STREAM], 64, "u1")


def test_columns(spark):
    noise = np.random.default_rng(0).integers(-(2**31), 2**31, 5).tolist()
    rows = [(0, [5, 6, 7] * 20), (1, None), (2, []), (3, [1, None]), (4, noise), (5, [-3])]
    df = spark.createDataFrame(rows, "k int, x array<int>").withColumn("c", rice.rice_compress(F.col("x")))
    got = {r["k"]: r for r in df.select("k", "c", rice.rice_expand(F.col("c.data"), F.col("c.size")).alias("y")).collect()}
    assert [got[k]["y"] for k in range(6)] == [rows[0][1], None, [], None, None, [-3]]
    assert got[0]["c"]["len"] == len(got[0]["c"]["data"]) < 60 and (got[4]["c"]["len"], got[4]["c"]["size"]) == (-1, 5)
    assert got[1]["c"] is None and got[3]["c"] is None and got[2]["c"]["len"] == 0
    assert df.where("false").count() == 0

"""Median cut against a plain version that splits one box at a time."""

import numpy as np
import pytest

from cellgrid.operators import colours

WEIGHTS = np.array([0.299, 0.587, 0.114])


def plain(pixels, n):
    boxes = {1: pixels}
    while len(boxes) < n:
        splits = [k for k, b in boxes.items() if len(np.unique(b, axis=0)) > 1]
        if not splits:
            break
        node = max(splits, key=lambda k: (len(boxes[k]), -k))
        b = boxes.pop(node)
        c = int(np.argmax(WEIGHTS * np.ptp(b, axis=0)))
        levels = np.unique(b[:, c])
        t = next((k for k in levels[:-1] if 2 * (b[:, c] <= k).sum() >= len(b)), levels[-2])
        boxes |= {2 * node: b[b[:, c] <= t], 2 * node + 1: b[b[:, c] > t]}
    boxes = list(boxes.values())
    lut = sorted({tuple((2 * b.sum(axis=0) + len(b)) // (2 * len(b))) for b in boxes})
    far = ((pixels[:, None] - np.array(lut)[None]) ** 2).sum(axis=2)
    return [tuple(map(int, c)) for c in lut], far.argmin(axis=1).tolist()


@pytest.mark.parametrize("n", [1, 2, 7, 64])
def test_median_cut(spark, n):
    rng = np.random.default_rng(n)
    pixels = np.clip(np.concatenate([rng.normal(60, 9, (300, 3)), rng.normal([200, 90, 30], 30, (150, 3)), np.full((50, 3), 17)]), 0, 255).astype(int)
    img = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(pixels)], "k int, r int, g int, b int")
    got, table = colours.cquant(img, n)
    lut, nearest = plain(pixels, n)
    assert [tuple(r)[1:] for r in table.orderBy("colour").collect()] == lut
    assert [r["colour"] for r in got.orderBy("k").collect()] == nearest


def test_few_colours_and_none(spark):
    img = spark.createDataFrame([(0, 1, 2, 3), (1, 250, 0, 9), (2, 1, 2, 3), (3, None, 2, 3)], "k int, r int, g int, b int")
    got, table = colours.cquant(img)
    back = colours.interlrgb(got.select("k", "colour"), table).orderBy("k").collect()
    assert [tuple(r[c] for c in "rgb") for r in back] == [(1, 2, 3), (250, 0, 9), (1, 2, 3), (None, None, None)] and table.count() == 2
    got, table = colours.cquant(img.where("r is null"))
    assert table.count() == 0 and got.first()["colour"] is None
    with pytest.raises(Exception, match="no level of a colour"):
        colours.cquant(spark.createDataFrame([(256, 0, 0)], "r int, g int, b int"))


def test_palette_lookup(spark):
    # A palette image and its colours.
    lut = spark.createDataFrame([(0, 0, 0, 0), (1, 10, 1, 10), (2, 2, 20, 20), (3, 30, 30, 3)], "colour int, r int, g int, b int")
    img = spark.createDataFrame([(i, j, c) for j, row in enumerate([[1, 2, 3], [0, 3, 0]]) for i, c in enumerate(row)], "i int, j int, colour int")
    got = [tuple(r[c] for c in "rgb") for r in colours.interlrgb(img, lut).orderBy("j", "i").collect()]
    assert got == [(10, 1, 10), (2, 20, 20), (30, 30, 3), (0, 0, 0), (30, 30, 3), (0, 0, 0)]

"""Forces against published figures and against all pairs."""

import numpy as np
import pytest

from cellgrid.operators import forces

COORDS = [[0, -1, 0], [-1, -1, -2], [3, 5, 2], [2, 1, -3], [1, 3, 1], [1, 1, 2]]


def frame(spark, points):
    return spark.createDataFrame([(n, None if p is None else [None if x is None else float(x) for x in p]) for n, p in enumerate(points)], "n long, p array<double>").repartition(3)


def found(df):
    return {r["n"]: r["force"] for r in df.collect()}


def test_published_forces(spark):
    got = found(forces.repulse(frame(spark, COORDS), "n", "p", 3.0, -100.0, -5.0, -0.1, 0.01))
    want = [[-19.9785, -83.469, 27.7307], [-75.2499, -57.671, -78.2403], [57.7644, 92.1679, 42.674], [47.2407, 6.71818, -93.5201], [-15.8246, 75.1071, 8.60458], [6.04795, -32.8531, 92.7511]]
    np.testing.assert_allclose([got[n] for n in range(6)], want, atol=1e-2)
    links = spark.createDataFrame([(a, b, 1.0) for a, b in zip([0, 1, 2, 3, 4, 4, 4, 5, 5, 5], [1, 2, 3, 1, 0, 2, 3, 0, 1, 2], strict=True)], "src long, dst long, strength double")
    got = found(forces.attract(frame(spark, COORDS), "n", "p", links, 30.0, 1.0))
    want = [[172.197, 779.117, 199.115], [2054.32, 2486.76, 1963.34], [-2004.3, -3652.66, -2542.66], [-300.804, 1010.14, 1942.27], [211.198, -700.071, -680.188], [-132.611, 76.7175, -881.878]]
    np.testing.assert_allclose([got[n] for n in range(6)], want, atol=1e-2)


@pytest.mark.parametrize("crowd", [7, 4096])
def test_crowded_boxes(spark, crowd):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(40, 3)) * 0.2 + 0.5, rng.normal(size=(40, 3)) * 3, np.full((3, 3), 0.25)])
    got = found(forces.repulse(frame(spark, [*x.tolist(), None, [1, None, 2]]), "n", "p", 1.0, 1.0, -2.0, 0.5, 0.01, crowd))
    assert sorted(got) == list(range(83))
    box = np.trunc(x)
    for n in range(83):
        near = (np.abs(box - box[n]) <= 1).all(axis=1)
        way = x[n] - x[near]
        r = np.sqrt((way**2).sum(axis=1)) + 0.01
        np.testing.assert_allclose(got[n], -((1 / r**2 - 2 / r + 0.5 / np.sqrt(r))[:, None] * way).sum(axis=0), rtol=1e-8, atol=1e-9)
    none = spark.createDataFrame([], "src long, dst long, strength double")
    assert found(forces.attract(frame(spark, [[1, 2, 3]]), "n", "p", none, 1.0, 1.0)) == {0: [0.0, 0.0, 0.0]}

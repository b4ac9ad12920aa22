"""Whitening against numpy's eigenvectors and exact integer sums."""

import math

import numpy as np
import pytest

from cellgrid.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int, deviation string"
SF = "/root/testdata/sf0.001"


def frame(spark, vectors):
    rows = [(i, v, 1, "x", 0, "d") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(vectors):
    """What whiten returns, of all (id, list) rows, up to signs."""
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in good], dtype=object)
    n, sums = len(good), x.sum(axis=0)
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    c = (x * n - sums).astype(float) / n
    cov = c.T @ c / n
    values, turn = np.linalg.eigh(cov)
    return [i for i, _ in good], n, deviation.tolist(), c, values[::-1], turn[:, ::-1], cov


def check(got, vectors, k=8):
    ids, n, deviation, c, values, turn, cov = brute(vectors)
    k = min(k, c.shape[1])
    assert len(got) == n * k
    rows = {}
    for r in got:
        rows.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    for j in range(1, k + 1):
        share = values[j - 1] / np.trace(cov)
        want = c @ turn[:, j - 1] / math.sqrt(values[j - 1])
        mine = [rows[i, d][j] for i, d in zip(ids, deviation, strict=True)]
        assert all(len(m) == ids.count(m[0]["vec_id"]) and m[0]["n"] == n for m in mine)
        z = np.array([m[0]["whitened"] for m in mine])
        sign = np.sign(z @ want)
        np.testing.assert_allclose(z * sign, want, atol=1e-7)
        assert all(abs(m[0]["explained"] - share) < 1e-9 * share and m[0]["identity_error"] < 1e-9 for m in mine)


def test_query(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(queries.op11_embedding_whitening(spark, SF).collect(), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 1 + np.arange(12), 12).tolist()) for i in range(80)]
    vectors += [(100, None), (101, [None] + [1.0] * 11), (102, [math.nan] * 12), (103, [math.inf] * 12), vectors[5], vectors[5], (2**60 + 1, vectors[6][1]), (2**60 + 3, vectors[7][1])]
    got = whitening.whiten(frame(spark, vectors)).collect()
    check(got, vectors)
    assert {2**60 + 1, 2**60 + 3} <= {r["vec_id"] for r in got} and not {100, 101, 102, 103} & {r["vec_id"] for r in got}


def test_null_ids_few_rows_and_none(spark):
    got = whitening.whiten(frame(spark, [(None, [1.0, 2.0, 3.0]), (2**60 + 1, [1.0, 4.0, 3.0])])).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["whitened"] is None) for r in got) == [(i, c, c > 1) for i in ("1152921504606846977", "None") for c in (1, 2, 3)]
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 and r["deviation"] == 2048**2 for r in got)
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in got if r["component"] == 1)
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in same] == [(None, None, 0)] * 4
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [])])).count() == 0


def test_what_cannot_be_summed_is_an_error(spark):
    with pytest.raises(ValueError, match="from 1 to 2"):
        whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(OverflowError):
        whitening.whiten(frame(spark, [(1, [1e15]), (2, [-1e15]), *[(3, [0.0])] * 8]))


@pytest.mark.parametrize("spectrum", ["steep", "flat", "pairs"])
def test_blocks_are_certified(spectrum):
    d, k = 60, 6
    values = {"steep": 2.0 ** -np.arange(d), "flat": 1 + 0.001 * np.arange(d)[::-1], "pairs": np.repeat(2.0 ** -np.arange(d // 2), 2)}[spectrum]
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    v = (turn * values) @ turn.T
    calls = []

    def multiply(q):
        calls.append(q.shape[1])
        return v @ q

    got, vectors, passes = whitening.subspace(multiply, d, k)
    np.testing.assert_allclose(got, values[:k], rtol=1e-12)
    assert passes == len(calls) < 40 and calls == sorted(calls)
    assert np.linalg.norm(v @ vectors - vectors * got) < 1e-12
    if spectrum == "steep":
        assert max(calls) < d  # certified without the whole space


def test_sums_of_squares_up_to_a_long():
    """As of 600,000 rows or more: the largest entry's square times the dimensions is beyond a long, the sums are not."""
    c = np.random.default_rng(5).integers(-(2**28), 2**28, (50, 64))
    c[7, 3], c[8, 5] = 2**31, -(2**31) + 1
    assert int(np.abs(c).max()) ** 2 * 64 >= 2**63
    assert whitening.sums_of_squares(c).tolist() == (c.astype(object) ** 2).sum(axis=1).tolist()
    edge = np.array([[3037000499, 0, 0], [2**31, 2**31 - 1, 65535]])  # the second is 131,070 below 2**63
    assert whitening.sums_of_squares(edge).tolist() == [3037000499**2, 2**62 + (2**31 - 1) ** 2 + 65535**2]
    for beyond in ([[2**31, 2**31 - 1, 65536]], [[2**31, 2**31]], [[3037000500, 0]], [[2**30] * 8]):
        with pytest.raises(OverflowError):
            whitening.sums_of_squares(np.array(beyond))
    assert whitening.sums_of_squares(np.zeros((0, 3), np.int64)).tolist() == []


def test_deviations_of_a_large_table(spark):
    """One outlier among many rows: the bound of entries is beyond a long, no deviation is."""
    vectors = [(i, [float(i % 3)] * 8) for i in range(200)] + [(1000, [1.0e4] + [1.0] * 7)]
    check(whitening.whiten(frame(spark, vectors), components=1).collect(), vectors, 1)

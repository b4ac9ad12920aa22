"""Every array query against its SQL twin in DuckDB, and independence of partitioning."""

import math
import os

import duckdb
import pytest

from cellgrid.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        path = f"{SF}/{f}/*.parquet" if os.path.isdir(f"{SF}/{f}") else f"{SF}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    theirs = sorted(tuple(map(plain, r)) for r in want.fetchall())
    assert ours == theirs and ours


@pytest.mark.parametrize("name", ["fft_vectors", "svd_vectors"])
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

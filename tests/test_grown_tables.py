"""Queries on tables with more rows, or other values, than the given ones, against their SQL, exactly."""

import duckdb

from cellgrid.operators import ranged, sequences
from cellgrid.plans.queries import ORACLE_SQL, QUERIES
from cellgrid.plans.shared import materialize

SF = "/root/testdata/sf0.001"

def both(spark, name, folder, tables):
    """Rows of the query and of its SQL on tables given as SQL, each written as one file."""
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for table, sql in tables.items():
        path = f"{folder}/{table}.parquet"
        duck.execute(f"COPY ({sql}) TO '{path}' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(folder)).select(*names).collect()
    key = lambda r: r[:2]
    return sorted(map(tuple, got), key=key), sorted(want.fetchall(), key=key)

def test_counts_beyond_16_bits(spark, tmp_path):
    items = f"SELECT l_returnflag, l_linestatus, l_linenumber, l_suppkey FROM '{SF}/lineitem.parquet', range(500)"
    got, want = both(spark, "flex_arrays", tmp_path, {"lineitem": items})
    assert max(v for _, _, v in want) > 2**15
    assert got == want

def test_ties_of_prices_in_cents(spark, tmp_path):
    parts = "SELECT i AS p_partkey, CAST(1 + i * 7919 % 50 AS INT) AS p_size, (90000 + i) / 100 AS p_retailprice FROM range(2000) t(i)"
    got, want = both(spark, "polyval_grey", tmp_path, {"part": parts})
    assert got == want


def test_long_scans_write_the_vector_once(spark, tmp_path, monkeypatch):
    """Across the borders of chunks and ranges; each scan had numbered, dealt out and written all rows anew."""
    written = []
    monkeypatch.setattr(ranged, "materialize", lambda df, label, *a: written.append(df.columns) or materialize(df, label, *a))
    monkeypatch.setattr(ranged, "CHUNK", 100)
    got, want = both(spark, "long_scans", tmp_path, {"lineitem": f"SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey % 5 = 0"})
    assert got == want and len(got) > 1000
    assert written == [["l_quantity", "l_discount", "_r", "_p"]]


def test_scans_along_are_the_single_ones(spark, monkeypatch):
    monkeypatch.setattr(ranged, "CHUNK", 4)
    for rows in ([(i, None if i % 5 in (0, 3) else i * i + 1.0) for i in range(18)], [(0, 3.0)], []):
        x = materialize(spark.createDataFrame(rows, "i long, v double"), "x")
        scans = ["cumusumover", "locf", "numdiff", "diffcentred"]
        got = sequences.along(x, "i", {f: (f, "v") for f in scans})
        assert got.columns == ["i", "v", *scans]
        for f in scans:
            one = getattr(sequences, f)(x, [], ["i"], "v", "out").select("i", "out")
            assert sorted(map(tuple, got.select("i", f).collect())) == sorted(map(tuple, one.collect()))

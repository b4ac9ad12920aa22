"""Every query of the subpackage over tables with every oddity: against brute force, or against its SQL."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cellgrid.llm import packing, queries, tokens
from tests.llm.test_operators import brute_groups, brute_kept, brute_quality, brute_targets, words_of


@pytest.fixture(scope="module")
def folder(odd, spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    odd.drop("v", "row").write.parquet(f"{at}/documents.parquet")
    html = ["", None, "<p>one</p>", "<p>one</p>", "é" * 5000, "<p>two</p>", "<p>one</p>", "x" * 300_000]
    urls = [None, "", "http://a.com/x", "HTTP://www.Example.com/en/a?b", "https://x.net/fr/1#c", "ftp://b.example.com/en/", "no scheme", "http://net/es/"]
    rows = [(i * 7 % 31, u, h) for i, (u, h) in enumerate(zip(urls * 3, html * 3, strict=True))] + [(500, None, None), (500, None, None)]
    rows += [(2**60 + 1, "http://a.com/1", "far"), (2**60 + 2, None, "<p>two</p>"), (2**60 + 3, "http://a.com/3", "far"), (None, "http://a.com/0", "far")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    return str(at)


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_op1(spark, folder, odd_rows):
    want = Counter((d, f"{fp:016x}", c) for d, fp, c, _ in brute_groups([r[:2] for r in odd_rows], 3, 2))
    assert rows(queries.op1_simhash_near_dedup(spark, folder)) == want


def test_op3(spark, folder, odd_rows):
    path = tokens.vocabulary()
    assert rows(queries.op3_token_counts(spark, folder)) == Counter((r[0], len(tokens.token_ids(r[1], path))) for r in odd_rows)


def test_op5(spark, folder, odd_rows):
    want = Counter((r[0], *brute_quality(r[1]), k) for r, k in zip(odd_rows, brute_kept([r[1] for r in odd_rows]), strict=True))
    assert rows(queries.op5_quality_rules(spark, folder)) == want


def test_op8(spark, folder, odd_rows):
    sizes, largest = Counter(), Counter()
    for r in odd_rows:
        n = len(words_of(r[1]))
        sizes[r[3]] += n
        largest[r[3]] = max(largest[r[3]], 3 * n)  # rows repeated as a whole go together
    goals, taken = brute_targets(sizes), Counter()
    source = {n: s for s, n in sizes.items()}
    assert len(source) == len(sizes)
    got = queries.op8_source_mix(spark, folder).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in odd_rows)
    for r in got:
        s = source[r["source_size"]]
        assert r["target"] == pytest.approx(goals[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - goals[s]) <= largest[s] for s in sizes)


def test_op9(spark, folder, odd_rows):
    path, want, bins = tokens.vocabulary(), Counter(), defaultdict(list)
    for r in odd_rows:
        ids = np.append(tokens.token_ids(r[1], path), 2).astype("<u4")
        for i, (a, n) in enumerate(packing.cut_points(len(ids), 1024)):
            want[r[0], i, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    got = queries.op9_best_fit_packing(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        ends = [0]
        for at, n in sorted(held):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 1024
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 1024) * 1.1 + 1


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.select(columns)) == Counter(want.fetchall())

"""Contours against squares taken one by one, paths against walks."""

import math
import random
from collections import Counter

import pytest

from cellgrid.operators import paths


def joined(spark, edges, directed=True):
    df = spark.createDataFrame(edges, "src int, dst int").repartition(3)
    rows = paths.path_segs(paths.path_join(df, directed)).orderBy("path").collect()
    assert [r["path"] for r in rows] == list(range(len(rows)))
    return [r["nodes"] for r in rows]


def test_published_paths(spark):
    assert joined(spark, [(0, 1), (2, 3), (4, 5)]) == [[0, 1], [2, 3], [4, 5]]
    edges = [(0, 1), (1, 2), (2, 3), (3, 1), (3, 2), (4, 5)]
    assert joined(spark, edges) == [[0, 1, 2, 3, 1], [3, 2], [4, 5]]
    assert joined(spark, [*edges, (6, 7), (7, 8), (8, 6)])[-1] == [6, 7, 8, 6]
    lines = joined(spark, edges, False)
    assert sorted(map(len, lines)) == [2, 2, 5] and [4, 5] in lines  # as published, up to direction


@pytest.mark.parametrize("directed", [True, False])
def test_long_paths_and_rings(spark, directed):
    rng = random.Random(6)
    nodes = rng.sample(range(1000), 160)
    path, ring, two = nodes[:97], nodes[97:134], nodes[134:136]
    edges = list(zip(path, path[1:])) + list(zip(ring, ring[1:] + ring[:1])) + [(two[0], two[1]), (nodes[140], nodes[140])]
    if not directed:
        edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    rng.shuffle(edges)
    got = sorted(joined(spark, edges, directed), key=len)
    assert [len(g) for g in got] == [2, 2, 38, 97]
    assert got[3] in (path, path[::-1]) and (not directed or got[3] == path)
    assert got[2][0] == got[2][-1] and set(got[2]) == set(ring)
    assert {frozenset(e) for e in zip(got[2], got[2][1:])} == {frozenset(e) for e in zip(ring, ring[1:] + ring[:1])}
    assert {tuple(g) for g in got[:2]} <= {tuple(two), tuple(two[::-1]), (nodes[140],) * 2}


def test_no_edges(spark):
    assert joined(spark, []) == [] and joined(spark, [(None, 1)]) == []


def test_every_edge_once(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(60)]
    got = joined(spark, edges)
    assert Counter(e for g in got for e in zip(g, g[1:])) == Counter(edges)
    got = joined(spark, edges, False)
    assert Counter(tuple(sorted(e)) for g in got for e in zip(g, g[1:])) == Counter(tuple(sorted(e)) for e in edges)


def brute_segments(v, levels):
    out = Counter()
    n, m = len(v), len(v[0])
    for c in levels:
        for i in range(n - 1):
            for j in range(m - 1):
                corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
                if any(v[a][b] is None for a, b in corners):
                    continue

                def point(p, q):
                    x, y = v[p[0]][p[1]], v[q[0]][q[1]]
                    t = (c - x) / (y - x)
                    return round(p[0] + t * (q[0] - p[0]), 6), round(p[1] + t * (q[1] - p[1]), 6)

                cut = [(p, q) for p, q in zip(corners, corners[1:] + corners[:1]) if (v[p[0]][p[1]] < c) != (v[q[0]][q[1]] < c)]
                pairs = [cut] if len(cut) == 2 else [(cut[0], cut[1]), (cut[2], cut[3])] if cut else []
                for a, b in pairs:
                    out[c, frozenset([point(*a), point(*b)])] += 1
    return out


def cells(spark, v):
    return spark.createDataFrame([(i, j, x) for i, row in enumerate(v) for j, x in enumerate(row)], "i int, j int, v double").repartition(3)


@pytest.mark.parametrize("tile", [2, 5, 128])
def test_contours_do_not_depend_on_tiles(spark, tile):
    rng = random.Random(3)
    v = [[None if rng.random() < 0.05 else rng.choice([0.0, 1.0, 2.0, rng.random() * 2]) for _ in range(13)] for _ in range(9)]
    levels = [0.5, 1.25]
    want = brute_segments(v, levels)
    got = paths.contour_segments(cells(spark, v), (9, 13), levels, tile).collect()
    assert Counter((r["level"], frozenset([(round(r["ai"], 6), round(r["aj"], 6)), (round(r["bi"], 6), round(r["bj"], 6))])) for r in got) == want
    lines = {}
    for r in paths.contour_polylines(cells(spark, v), (9, 13), levels, tile).collect():
        lines.setdefault((r["level"], r["path"], r["closed"]), {})[r["nth"]] = (round(r["i"], 6), round(r["j"], 6))
    used = Counter()
    for (level, _, closed), at in lines.items():
        points = [at[k] for k in range(len(at))]
        assert closed == (points[0] == points[-1])
        used.update((level, frozenset(e)) for e in zip(points, points[1:]))
    assert used == want


def test_published_contours(spark):
    ring = [[0, 0, 0, 0, 0], [0, 0, 1, 0, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]]
    want = {(0.5, 2), (0.5, 3), (1, 1.5), (1, 3.5), (1.5, 1), (1.5, 2), (2, 0.5), (2, 1.5), (2, 2.5), (2, 3.5), (2.5, 1), (2.5, 2), (3, 1.5), (3, 3.5), (3.5, 2), (3.5, 3)}
    got = paths.contour_segments(cells(spark, [[float(ring[j][i]) for j in range(5)] for i in range(5)]), (5, 5), [0.5]).collect()
    assert {p for r in got for p in ((r["ai"], r["aj"]), (r["bi"], r["bj"]))} == want
    wave = [[0.5 + 0.5 * (math.sin(x / 5 * 6.3) * math.sin(y / 5 * 6.3)) ** 3 for y in range(6)] for x in range(6)]
    counts = Counter(r["level"] for r in paths.contour_segments(cells(spark, wave), (6, 6), [0.203, 0.276]).collect())
    assert counts == {0.203: 8, 0.276: 8}

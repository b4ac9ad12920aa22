"""Contours of images, and edges joined to paths.

A contour's points lie on edges between neighbouring cells and are named by these, so what one tile finds fits
to what the next one does.  Paths are put in order by pointer doubling: a path of n edges takes log2(n) joins,
and no task sees more of it than any other rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.operators import ranged
from cellgrid.operators.signal import TILE
from cellgrid.plans.shared import materialize

SEGMENTS = "level double, a long, b long, ai double, aj double, bi double, bj double"


def contour_segments(img: DataFrame, shape: tuple[int, int], levels: list[float], tile: int = TILE) -> DataFrame:
    """Rows of SEGMENTS: pieces of the lines at each level of an image ``(i, j, v)``, each within a square of four cells.

    A line crosses an edge of which just one end is below the level, where the linear interpolant has it.
    ``a`` and ``b`` name the crossed edges: twice the place of the first cell, and one more along j.  In a square
    whose corners are above and below by turns, the lines cut off the corners at (i + 1, j) and (i, j + 1).
    A square with a missing corner has no line.
    """
    wide = shape[1]

    def homes(c: str) -> Column:
        at = F.floor(F.col(c) / tile)
        return F.filter(F.array(at, F.when(F.col(c) % tile == 0, at - 1)), lambda x: x >= 0)

    def each(g: pd.DataFrame) -> pd.DataFrame:
        top, left = int(g["_ti"].iloc[0]) * tile, int(g["_tj"].iloc[0]) * tile
        m = np.full((tile + 1, tile + 1), np.nan)
        m[g["i"] - top, g["j"] - left] = g["v"].to_numpy(float)
        full = ~np.isnan(m[:-1, :-1] + m[1:, :-1] + m[:-1, 1:] + m[1:, 1:])
        i, j = np.indices(m.shape)
        found = []
        for level in levels:
            below = m < level
            with np.errstate(all="ignore"):
                down = (level - m[:-1]) / (m[1:] - m[:-1])  # how far along i, and along j, the level is
                across = (level - m[:, :-1]) / (m[:, 1:] - m[:, :-1])
            cut_i, cut_j = below[:-1] != below[1:], below[:, :-1] != below[:, 1:]
            # the four sides of each square: crossed or not, name, and place of the point
            names = 2 * ((i + top) * wide + j + left)
            side = {
                "low": (cut_i[:, :-1], names[:-1, :-1], (i + top)[:-1, :-1] + down[:, :-1], (j + left)[:-1, :-1]),
                "high": (cut_i[:, 1:], names[:-1, 1:], (i + top)[:-1, 1:] + down[:, 1:], (j + left)[:-1, 1:]),
                "first": (cut_j[:-1], names[:-1, :-1] + 1, (i + top)[:-1, :-1], (j + left)[:-1, :-1] + across[:-1]),
                "last": (cut_j[1:], names[1:, :-1] + 1, (i + top)[1:, :-1], (j + left)[1:, :-1] + across[1:]),
            }
            saddle = np.logical_and.reduce([s[0] for s in side.values()])
            for p, q in (("low", "high"), ("first", "last"), ("low", "first"), ("low", "last"), ("first", "high"), ("last", "high")):
                here = side[p][0] & side[q][0] & full
                here &= ~saddle if (p, q) not in (("low", "last"), ("first", "high")) else True
                if here.any():
                    a, b = ([np.broadcast_to(x, here.shape)[here] for x in side[n][1:]] for n in (p, q))
                    found.append(pd.DataFrame({"level": level, "a": a[0], "b": b[0], "ai": a[1], "aj": a[2], "bi": b[1], "bj": b[2]}))
        return pd.concat(found) if found else pd.DataFrame(columns=[x.split()[0] for x in SEGMENTS.split(", ")])

    cells = img.where(F.col("v").isNotNull()).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    sent = cells.withColumn("_ti", F.explode(homes("i"))).withColumn("_tj", F.explode(homes("j")))
    return sent.groupBy("_ti", "_tj").applyInPandas(each, SEGMENTS)


def _darts(edges: DataFrame, directed: bool) -> DataFrame:
    """Ways along edges ``(dart, tail, head, next)``: each goes on with at most one other, and is gone on to by one.

    At each node the k-th way in is joined to the k-th way out; without directions ends are joined by twos.
    """
    numbered = ranged.indexed(edges, ["src", "dst"], "e")
    numbered = materialize(numbered.select("e", "src", "dst"), "numbered")
    if directed:
        nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("e"))
        into = numbered.select("e", "src", "dst", nth("dst").alias("k"))
        out = numbered.select(F.col("e").alias("next"), F.col("src").alias("dst"), nth("src").alias("k"))
        return into.join(out, ["dst", "k"], "left").select(F.col("e").alias("dart"), F.col("src").alias("tail"), F.col("dst").alias("head"), "next")
    # dart 2 e goes from src to dst, 2 e + 1 back; an end is named by the dart that leaves from it
    ways = numbered.select(F.explode(F.array(F.struct((2 * F.col("e")).alias("dart"), F.col("src").alias("tail"), F.col("dst").alias("head")), F.struct((2 * F.col("e") + 1).alias("dart"), F.col("dst").alias("tail"), F.col("src").alias("head")))).alias("w")).select("w.*")
    ends = ways.withColumn("k", F.row_number().over(Window.partitionBy("tail").orderBy("dart")) - 1)
    pair = Window.partitionBy("tail", F.floor(F.col("k") / 2)).orderBy("k")
    ends = ends.select("dart", F.coalesce(F.lead("dart").over(pair), F.lag("dart").over(pair)).alias("other"))
    # arriving by the dart whose reverse leaves from an end goes on with that end's partner
    return ways.join(ends.select(F.col("dart").bitwiseXOR(F.lit(1)).alias("dart"), F.col("other").alias("next")), "dart").select("dart", "tail", "head", "next")


def _doubled(now: DataFrame) -> DataFrame:
    """One doubling of ``(dart, next, steps, end, least)``: where twice as many steps lead, and the least dart on the way."""
    ahead = now.select(F.col("dart").alias("next"), F.col("next").alias("next2"), F.col("steps").alias("steps2"), F.col("end").alias("end2"), F.col("least").alias("least2"))
    got = now.where("next is not null").join(ahead, "next").select("dart", F.col("next2").alias("next"), (F.col("steps") + F.col("steps2")).alias("steps"), F.col("end2").alias("end"), F.least("least", "least2").alias("least"))
    return got.unionAll(now.where("next is null").select("dart", "next", "steps", "end", "least"))


def _ranked(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(dart, steps, end)``: steps to the last dart of the chain, and that one; and ``(dart, least)`` of darts in cycles."""
    start = links.select("dart", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.coalesce("next", "dart").alias("end"), F.least("dart", F.coalesce("next", "dart")).alias("least"))
    now, open_before = materialize(start, "ranks"), None
    while True:
        left = now.where("next is not null").count()
        if not left or left == open_before:
            break
        now, open_before = materialize(_doubled(now), "ranks"), left
    rings, before = now.where("next is not null"), None
    while left:
        total = rings.agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0]  # least darts only fall, until all are the ring's
        if total == before:
            break
        rings, before = materialize(_doubled(rings), "rings"), total
    return now.where("next is null").select("dart", "steps", "end"), rings.select("dart", "least")


def path_join(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Rows ``(path, nth, node)`` of the paths that edges ``(src, dst)`` make up, with every edge in one path, once.

    Paths go through a node as often as it has ways in and out, and end where one is left over.  A cycle starts
    and ends at one node; ``closed``, the fourth column, is true for it.  Without directions a path is given one
    way only.  Paths are numbered from 0 by their first edge in order of nodes; edges with a missing end are left out.
    """
    given = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    darts = materialize(_darts(given, directed), "darts")
    chains, rings = _ranked(darts.select("dart", "next"))
    # rings are cut before their least dart; without directions the one with that edge's first dart is kept
    if not directed:
        rings = rings.where(F.col("least") % 2 == 0)
    rings = materialize(rings, "rings")
    cut = darts.join(rings, "dart").select("dart", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"), "least")
    unrolled, _ = _ranked(cut.select("dart", "next"))
    both = chains.withColumn("closed", F.lit(False)).unionAll(unrolled.withColumn("closed", F.lit(True)))
    both = materialize(both.join(darts.select("dart", "tail", "head"), "dart"), "chains")
    heads = both.groupBy("end").agg(F.max("steps").alias("length"), F.max_by("dart", "steps").alias("first"), F.max_by("tail", "steps").alias("from"), F.min_by("head", "steps").alias("to"), F.first("closed").alias("closed"))
    if not directed:
        back = F.col("end").bitwiseXOR(F.lit(1))  # the first dart of the same path the other way
        heads = heads.where(F.col("closed") | (F.struct(F.col("from"), F.col("first")) < F.struct(F.col("to").alias("from"), back.alias("first"))))
    named = ranged.indexed(heads.select("end", "length", "first"), ["first"], "path")
    rows = both.join(materialize(named, "paths"), "end")
    nodes = F.when(F.col("steps") == 0, F.array(F.struct((F.col("length") - F.col("steps")).alias("nth"), F.col("tail").alias("node")), F.struct((F.col("length") + 1).alias("nth"), F.col("head").alias("node")))).otherwise(F.array(F.struct((F.col("length") - F.col("steps")).alias("nth"), F.col("tail").alias("node"))))
    return rows.select("path", F.explode(nodes).alias("n"), "closed").select("path", "n.nth", "n.node", "closed")


def path_segs(paths: DataFrame) -> DataFrame:
    """``(path, nodes)``: each path's nodes in one array."""
    held = F.array_sort(F.collect_list(F.struct("nth", "node")))
    return paths.groupBy("path").agg(F.transform(held, lambda x: x["node"]).alias("nodes"))


def contour_polylines(img: DataFrame, shape: tuple[int, int], levels: list[float], tile: int = TILE) -> DataFrame:
    """Rows ``(level, path, nth, i, j, closed)``: the contours' points in the order of their lines."""
    pieces = materialize(contour_segments(img, shape, levels, tile), "segments")
    size = 2 * shape[0] * shape[1]
    which = F.lit(0)
    for k, level in enumerate(levels):
        which = F.when(F.col("level") == level, k).otherwise(which)
    node = lambda c: (which * F.lit(size).cast("long") + F.col(c)).alias({"a": "src", "b": "dst"}[c])
    lines = path_join(pieces.select(node("a"), node("b")), directed=False)
    ends = pieces.select(node("a").alias("node"), "level", F.col("ai").alias("i"), F.col("aj").alias("j")).unionAll(pieces.select(node("b").alias("node"), "level", "bi", "bj"))
    points = ends.groupBy("node").agg(F.first("level").alias("level"), F.first("i").alias("i"), F.first("j").alias("j"))
    return lines.join(points, "node").select("level", "path", "nth", "i", "j", "closed")

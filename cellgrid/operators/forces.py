"""Forces between points in space: those of all that are near, and along links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

# Points of a box that one task moves; a box with more is dealt to several, each with all that acts on it.
CROWD = 4096
SIDE = 1024


def _box(at: str, size: float) -> Column:
    """Whole boxes toward zero, of three coordinates."""
    return F.transform(at, lambda x: F.when(x < 0, F.ceil(x / size)).otherwise(F.floor(x / size)))


def repulse(points: DataFrame, key: str, at: str, size: float, a: float, b: float, c: float, d: float = 0.01, crowd: int = CROWD) -> DataFrame:
    """``(key, force)``: for every point the sum of (a / r^2 + b / r + c / r^0.5) times the way from it to each point
    in its own box and the 26 around, where r is their distance and ``d`` more.

    Points are packed in space of three dimensions; those with a missing coordinate are left out.  Keys must differ.
    Boxes of ``size`` on a side are cut toward zero, so that those about it are twice as wide.  Each point is sent to
    the boxes that it acts on, and pairs are summed within tasks, never written.
    """
    good = points.select(F.col(key).alias("_key"), F.col(at).cast("array<double>").alias("_at")).where((F.size("_at") == 3) & ~F.exists("_at", lambda x: x.isNull()))
    good = materialize(good.withColumns({"_box": _box("_at", size), "_id": F.monotonically_increasing_id()}), "points")
    parts = materialize(good.groupBy("_box").agg(F.ceil(F.count("*") / crowd).alias("_parts")), "boxes")
    moved = good.join(parts, "_box").select("_box", F.pmod(F.xxhash64("_id"), F.col("_parts")).alias("_part"), "_id", "_at", F.lit(True).alias("_moved"))
    steps = F.array(*[F.array(*[F.lit(s).cast("long") for s in (x, y, z)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
    sent = good.select("_id", "_at", F.explode(F.transform(steps, lambda s: F.zip_with("_box", s, lambda p, q: p + q))).alias("_box"))
    sent = sent.join(parts, "_box").select("_box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"), "_id", "_at", F.lit(False).alias("_moved"))

    def each(g: pd.DataFrame) -> pd.DataFrame:
        mine, near = g[g["_moved"]], g[~g["_moved"]]
        x, y = np.stack(mine["_at"].to_numpy()), np.stack(near["_at"].to_numpy())
        total = np.zeros_like(x)
        for lo in range(0, len(x), SIDE):
            for to in range(0, len(y), SIDE):
                way = x[lo : lo + SIDE, None] - y[None, to : to + SIDE]
                r = np.sqrt((way * way).sum(axis=2)) + d
                total[lo : lo + SIDE] -= ((a / r**2 + b / r + c / np.sqrt(r))[:, :, None] * way).sum(axis=1)  # a point has no way to itself
        return pd.DataFrame({"_id": mine["_id"], "force": list(total)})

    forces = moved.unionAll(sent).groupBy("_box", "_part").applyInPandas(each, "_id long, force array<double>")
    return good.select("_id", F.col("_key").alias(key)).join(forces, "_id").select(key, "force")


def attract(points: DataFrame, key: str, at: str, links: DataFrame, m: float, ms: float) -> DataFrame:
    """``(key, force)``: links ``(src, dst, strength)`` pull their ends together with ``strength`` times ms r^2 + m r for
    each unit of their distance r.  A point without links has a force of 0; a link to no point is left out."""
    held = points.select(F.col(key).alias("_key"), F.col(at).cast("array<double>").alias("_at"))
    ends = links.join(held.select(F.col("_key").alias("src"), F.col("_at").alias("_a")), "src").join(held.select(F.col("_key").alias("dst"), F.col("_at").alias("_b")), "dst")
    way = ends.select("src", "dst", "strength", F.zip_with("_a", "_b", lambda x, y: x - y).alias("_w"))
    r2 = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x * x)
    pull = way.select("src", "dst", F.col("_w"), (F.col("strength") * (ms * r2 + m * F.sqrt(r2))).alias("_s"))
    both = pull.select(F.explode(F.array(F.struct(F.col("src").alias("_key"), (-F.col("_s")).alias("f")), F.struct(F.col("dst").alias("_key"), F.col("_s").alias("f")))).alias("e"), "_w").select("e.*", "_w")
    parts = both.select("_key", F.posexplode("_w").alias("n", "x"), "f").groupBy("_key", "n").agg(F.sum(F.col("x") * F.col("f")).alias("x"))
    packed = parts.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("p")).select("_key", F.transform("p", lambda e: e["x"]).alias("force"))
    none = F.transform("_at", lambda x: x * 0)
    return held.join(packed, "_key", "left").select(F.col("_key").alias(key), F.coalesce("force", none).alias("force"))

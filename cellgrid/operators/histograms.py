"""Histograms and scatter-add.  Bins are counted in partial aggregates; out-of-range values go to the edge bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.operators import ranged


def bin_of(v: Column, step: float, low: float, bins: int) -> Column:
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(bins - 1.0), (v - low) / step))).cast("long")


def _filled(df: DataFrame, sums: DataFrame, sizes: dict[str, int], out: str, by: list[str]) -> DataFrame:
    grid = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    for name, n in sizes.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return ranged.same_keys(grid, sums, [*by, *sizes], "left").select(*by, *sizes, F.coalesce(out, F.lit(0)).alias(out))


def histogram(df: DataFrame, v: str, step: float, low: float, bins: int, weight: str | None = None, by: list[str] | None = None, out: str = "hist") -> DataFrame:
    """``(bin, hist)``: counts, or sums of ``weight``, with a row for every bin of every group."""
    by = by or []
    good = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    sums = good.groupBy(*by, bin_of(F.col(v), step, low, bins).alias("bin")).agg((F.sum(weight) if weight else F.count("*")).alias(out))
    return _filled(df, sums, {"bin": bins}, out, by)


def histogram2d(df: DataFrame, a: str, b: str, steps: tuple, lows: tuple, bins: tuple, weight: str | None = None, out: str = "hist") -> DataFrame:
    """``(bin_a, bin_b, hist)``; cells missing or NaN in either are left out."""
    good = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double")))
    keys = [bin_of(F.col(c), s, lo, n).alias(name) for c, s, lo, n, name in zip((a, b), steps, lows, bins, ("bin_a", "bin_b"), strict=True)]
    sums = good.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias(out))
    return _filled(df, sums, {"bin_a": bins[0], "bin_b": bins[1]}, out, [])


def hist(df: DataFrame, v: str, low: float | None = None, high: float | None = None, step: float | None = None, weight: str | None = None) -> DataFrame:
    """``(centre, bin, hist)`` with limits and step taken from the data where they are not given, by one job.

    Without a good value there is one bin around 0, or around the limits given, that holds nothing.  Infinite
    values set no limit; they are in the first and last bin.
    """
    size = F.abs(F.col(v).cast("double"))
    number = F.when(~F.isnan(size) & (size != F.lit(math.inf)), F.col(v))
    lo, hi, n = df.agg(F.min(number), F.max(number), F.count(number)).first()
    lo, hi = (0.0, 0.0) if not n else (lo, hi)
    low, high = lo if low is None else low, hi if high is None else high
    if step is None:
        step = (high - low) / min(100, math.sqrt(max(1, n))) or 1.0
    bins = max(1, int((high - low) / step + 0.5))
    found = histogram(df, v, step, low, bins, weight)
    return found.select((F.lit(low) + (F.col("bin") + 0.5) * step).alias("centre"), "bin", "hist")


def indadd(df: DataFrame, v: str, index: str, size: int, out: str = "total") -> DataFrame:
    """Sums of ``v`` scattered to ``size`` places; an index out of range is an error, a missing value makes its place missing."""
    i = F.when(F.col(index).between(0, size - 1), F.col(index)).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))
    sums = df.groupBy(i.cast("long").alias("i0")).agg(F.when(F.count("*") == F.count(v), F.sum(v)).alias(out), F.lit(1).alias("_hit"))
    return df.sparkSession.range(size).withColumnRenamed("id", "i0").join(sums, "i0", "left").select("i0", F.when(F.col("_hit").isNull(), 0).otherwise(F.col(out)).alias(out))

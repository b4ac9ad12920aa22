"""Leaf relations: cells with index columns, made in parallel by ``spark.range``."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, shape: list[int]) -> DataFrame:
    """Index columns ``i0...`` of every cell, the first dimension fastest."""
    cells = spark.range(math.prod(shape))
    out, step = [], 1
    for k, n in enumerate(shape):
        out.append(F.pmod(F.floor(F.col("id") / step), F.lit(n)).cast("long").alias(f"i{k}"))
        step *= n
    return cells.select("id", *out)


def _filled(spark: SparkSession, shape: list[int], v: Column) -> DataFrame:
    return grid(spark, shape).withColumn("v", v).drop("id")


def zeroes(spark: SparkSession, shape: list[int], dtype: str = "double") -> DataFrame:
    return _filled(spark, shape, F.lit(0).cast(dtype))


def ones(spark: SparkSession, shape: list[int], dtype: str = "double") -> DataFrame:
    return _filled(spark, shape, F.lit(1).cast(dtype))


def constant(spark: SparkSession, shape: list[int], value: float, dtype: str = "double") -> DataFrame:
    """Cells of one value, NaN or an infinity as well."""
    return _filled(spark, shape, F.lit(value).cast(dtype))


def empty(spark: SparkSession, dims: int = 1, dtype: str = "double") -> DataFrame:
    """An array without cells."""
    return spark.createDataFrame([], ", ".join([*(f"i{k} long" for k in range(dims)), f"v {dtype}"]))


def literal(spark: SparkSession, values: list, undef: float = 0.0) -> DataFrame:
    """Cells of a nested list, the innermost lists along the first dimension; short ones are filled with ``undef``, None is missing."""
    depth, level = 0, values
    while isinstance(level, list):
        depth, level = depth + 1, next((x for x in level if isinstance(x, list)), level[0] if level else 0.0)
    sizes = [0] * depth

    def measure(part: list, k: int) -> None:
        sizes[k] = max(sizes[k], len(part))
        for x in part:
            if isinstance(x, list):
                measure(x, k + 1)

    measure(values, 0)

    def rows(part: object, k: int, at: tuple) -> Iterator[tuple]:
        if k == depth:
            yield *reversed(at), None if part is None else float(part)
        else:
            held = part if isinstance(part, list) else [part]
            for n in range(sizes[k]):
                yield from rows(held[n] if n < len(held) else [] if k + 1 < depth else undef, k + 1, (*at, n))

    return spark.createDataFrame(list(rows(values, 0, ())), ", ".join([*(f"i{k} long" for k in range(depth)), "v double"]))


def sequence(spark: SparkSession, shape: list[int], dtype: str = "double") -> DataFrame:
    return _filled(spark, shape, F.col("id").cast(dtype))


def axisvals(spark: SparkSession, shape: list[int], axis: int) -> DataFrame:
    return _filled(spark, shape, F.col(f"i{axis}").cast("double"))


def axislinvals(spark: SparkSession, shape: list[int], axis: int, low: float, high: float) -> DataFrame:
    return _filled(spark, shape, F.lit(low) + F.col(f"i{axis}") * ((high - low) / (shape[axis] - 1)))


def axislogvals(spark: SparkSession, shape: list[int], axis: int, low: float, high: float) -> DataFrame:
    a, b = math.log(low), math.log(high)
    return _filled(spark, shape, F.exp(F.lit(a) + F.col(f"i{axis}") * ((b - a) / (shape[axis] - 1))))


def ndcoords(spark: SparkSession, shape: list[int]) -> DataFrame:
    return _filled(spark, shape, F.array(*[F.col(f"i{k}") for k in range(len(shape))]))


def rvals(spark: SparkSession, shape: list[int], centre: list[float] | None = None, squared: bool = False) -> DataFrame:
    """Distance of each cell from a centre, by default the middle cell."""
    centre = centre or [float(n // 2) for n in shape]
    r2 = sum(((F.col(f"i{k}") - c) * (F.col(f"i{k}") - c) for k, c in enumerate(centre)), F.lit(0.0))
    return _filled(spark, shape, r2 if squared else F.sqrt(r2))


def random(spark: SparkSession, shape: list[int], seed: int = 0, normal: bool = False) -> DataFrame:
    """Uniform in 0..1 or standard normal values; a seed repeats on the same partitioning."""
    return _filled(spark, shape, F.randn(seed) if normal else F.rand(seed))


def randsym(spark: SparkSession, shape: list[int], seed: int = 0) -> DataFrame:
    """Uniform strictly between 0 and 1."""
    return _filled(spark, shape, (F.floor(F.rand(seed) * float(1 << 52)) + 0.5) / float(1 << 52))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return _filled(spark, [n, n], (F.col("i0") == F.col("i1")).cast("double"))


def stretcher(vector: DataFrame) -> DataFrame:
    """Diagonal cells of a vector ``(i0, v)``; cells off the diagonal are absent."""
    return vector.select("i0", F.col("i0").alias("i1"), "v")


def meshgrid(parts: list[DataFrame]) -> DataFrame:
    """Vectors ``(i, v)`` on their common grid, as columns ``i0, v0, i1, v1...``."""
    out = None
    for k, p in enumerate(parts):
        p = p.select(F.col("i").alias(f"i{k}"), F.col("v").alias(f"v{k}"))
        out = p if out is None else out.crossJoin(p)
    return out


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """The first n numbers, exact up to the 92nd, which is the last that a long holds."""
    if n > 92:
        raise ValueError("beyond a long")
    step = lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b"))
    one = F.lit(1).cast("long")
    value = F.aggregate(F.sequence(F.lit(0), F.col("id").cast("int")), F.struct(F.lit(0).cast("long").alias("a"), one.alias("b")), lambda s, x: F.when(x == 0, F.struct(one.alias("a"), one.alias("b"))).otherwise(step(s, x)))
    return spark.range(n).select(F.col("id").alias("i0"), value["a"].alias("v"))


def earth_graticule(spark: SparkSession, step_degrees: int = 10) -> DataFrame:
    """Points of meridians and parallels ``(line, nth, lon, lat)`` in radians."""
    n, m = 360 // step_degrees, 180 // step_degrees + 1
    d = math.pi / 180
    meridian = grid(spark, [181, n]).select(F.col("i1").alias("line"), F.col("i0").alias("nth"), ((F.col("i1") * step_degrees - 180) * d).alias("lon"), ((F.col("i0") - 90) * d).alias("lat"))
    parallel = grid(spark, [361, m]).select((F.col("i1") + n).alias("line"), F.col("i0").alias("nth"), ((F.col("i0") - 180) * d).alias("lon"), ((F.col("i1") * step_degrees - 90) * d).alias("lat"))
    return meridian.unionAll(parallel)

"""Reductions over a dimension as aggregate columns: use them in ``groupBy(broadcast dims).agg(...)``.

All are built of Spark's own aggregates, so that they combine within partitions before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _number(v: Column) -> Column:
    """The value unless it is NaN."""
    return F.when(~F.isnan(v.cast("double")), v)


def sumover(v) -> Column:
    """Sum; 0 for no cells, missing if all cells are missing."""
    return F.when(F.count("*") == 0, 0).otherwise(F.sum(_c(v)))


def dsumover(v) -> Column:
    return sumover(_c(v).cast("double"))


def prodover(v) -> Column:
    """Product; a zero makes it 0 whatever else there is."""
    v = _c(v)
    return F.when(F.max((v == 0).cast("int")) == 1, 0.0).otherwise(F.product(v))


def average(v) -> Column:
    """Mean as double."""
    return F.avg(_c(v))


def average_int(v) -> Column:
    """Mean of whole numbers, cut off toward zero; 0 for no cells."""
    v = _c(v).cast("bigint")
    n = F.count(v)
    q = F.try_divide(F.abs(F.sum(v)) - F.try_mod(F.abs(F.sum(v)), n), n).cast("bigint")
    return F.when(F.count("*") == 0, 0).otherwise(F.when(F.sum(v) < 0, -q).otherwise(q))


def minimum(v) -> Column:
    """Smallest number; NaN only if there is nothing else."""
    v = _c(v)
    return F.coalesce(F.min(_number(v)), F.min(v))


def maximum(v) -> Column:
    v = _c(v)
    return F.coalesce(F.max(_number(v)), F.max(v))


def minimum_ind(v, i) -> Column:
    """Index of the smallest number, the first of ties."""
    v = _c(v)
    return F.min_by(_c(i), F.when(_number(v).isNotNull(), F.struct(v, _c(i))))


def maximum_ind(v, i) -> Column:
    v = _c(v)
    return F.max_by(_c(i), F.when(_number(v).isNotNull(), F.struct(v, -_c(i))))


def minmaximum(v, i) -> list[Column]:
    """Four columns: min, max and their first indices; NaN is ignored altogether."""
    n = _number(_c(v))
    return [F.min(n).alias("vmin"), F.max(n).alias("vmax"), minimum_ind(v, i).alias("min_ind"), maximum_ind(v, i).alias("max_ind")]


def medover(v) -> Column:
    """Median, for groups whose distinct values fit in a task (``sequences.medover`` has no such bound)."""
    return F.median(_c(v))


def pctover(v, p: float) -> Column:
    """Percentile, linear between neighbours at place (n - 1) p; p is clamped to 0..1; bounded as ``medover``."""
    return F.percentile(_c(v), min(1.0, max(0.0, p)))


def andover(v) -> Column:
    return F.coalesce(F.bool_and(_c(v) != 0), F.lit(True)).cast("int")


def orover(v) -> Column:
    return F.coalesce(F.bool_or(_c(v) != 0), F.lit(False)).cast("int")


def xorover(v) -> Column:
    return (F.count_if(_c(v) != 0) % 2).cast("int")


def zcover(v) -> Column:
    return F.coalesce(F.bool_and(_c(v) == 0), F.lit(True)).cast("int")


def bandover(v) -> Column:
    return F.coalesce(F.bit_and(_c(v)), F.lit(-1))


def borover(v) -> Column:
    return F.coalesce(F.bit_or(_c(v)), F.lit(0))


def bxorover(v) -> Column:
    return F.coalesce(F.bit_xor(_c(v)), F.lit(0))


def firstnonzeroover(v, i) -> Column:
    """First non-zero value in index order; 0 if there is none."""
    v = _c(v)
    return F.coalesce(F.min_by(v, F.when(v != 0, _c(i))), F.lit(0))


def nbadover(v) -> Column:
    return F.count("*") - F.count(_c(v))


def ngoodover(v) -> Column:
    return F.count(_c(v))


def magnover(v) -> Column:
    v = _c(v).cast("double")
    return F.sqrt(F.sum(v * v))


def wtstat(v, weight, avg, degree: int = 1) -> Column:
    v, w = _c(v).cast("double"), _c(weight)
    return F.try_divide(F.sum(w * (F.pow(v, F.lit(degree)) - avg)), F.sum(w))


def uniform_stats(v) -> list[Column]:
    """avg, prms, median, min, max and rms with unit weights, in one pass (mean deviation needs ``statsover``)."""
    v = _c(v).cast("double")
    prms = F.when(F.count(v) > 1, F.stddev_samp(v)).otherwise(0.0)
    return [F.avg(v).alias("avg"), prms.alias("prms"), F.median(v).alias("med"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.stddev_pop(v).alias("rms")]


REDUCE = {"+": sumover, "plus": sumover, "add": sumover, "dadd": dsumover, "*": prodover, "mult": prodover, "avg": average, "davg": average, "and": andover, "or": orover, "band": bandover, "bor": borover, "bxor": bxorover, "xor": xorover, "median": medover, "max": maximum, "min": minimum, "iszero": zcover}


def canreduce(name: str) -> bool:
    return name in REDUCE


def reduce(name, v) -> Column:
    """A reduction by name, as a user of the array language writes it, or by a function from a column to an aggregate."""
    return name(_c(v)) if callable(name) else REDUCE[name](v)

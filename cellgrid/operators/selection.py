"""Selection, gathering, slicing and reshaping: filters, index arithmetic and equi-joins on index columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDARIES = ("forbid", "truncate", "extend", "periodic", "mirror")


def true_mask(mask: Column) -> Column:
    """Missing counts as false."""
    return F.coalesce(mask.cast("double") != 0, F.lit(False))


def which(df: DataFrame, mask: Column, i: str) -> DataFrame:
    return df.where(true_mask(mask)).select(i)


def which_both(df: DataFrame, mask: Column, i: str) -> DataFrame:
    """All indices with ``side`` 1 where the mask is true, else 0."""
    return df.select(i, true_mask(mask).cast("int").alias("side"))


def where(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(true_mask(mask))


def where_both(df: DataFrame, mask: Column) -> tuple[DataFrame, DataFrame]:
    """The cells where the mask is true, and all others."""
    return df.where(true_mask(mask)), df.where(~true_mask(mask))


def which_nd(df: DataFrame, mask: Column, dims: list[str]) -> DataFrame:
    """Coordinates of the true cells, a column for each dimension."""
    return df.where(true_mask(mask)).select(*dims)


def which_nd_both(df: DataFrame, mask: Column, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    return which_nd(df, mask, dims), df.where(~true_mask(mask)).select(*dims)


def where_nd(df: DataFrame, mask: DataFrame, dims: list[str], m: str = "v") -> DataFrame:
    """Cells of a larger array whose leading coordinates are true in a mask array ``(dims..., m)``: a semi join."""
    return df.join(mask.where(true_mask(F.col(m))).select(*dims), dims, "left_semi")


def where_nd_both(df: DataFrame, mask: DataFrame, dims: list[str], m: str = "v") -> tuple[DataFrame, DataFrame]:
    return where_nd(df, mask, dims, m), df.join(mask.where(true_mask(F.col(m))).select(*dims), dims, "left_anti")


def whichover(df: DataFrame, by: list[str], mask: Column, i: str, size: int | None = None) -> DataFrame:
    """For each group an array of the true indices in order, padded with -1 to the dimension's size.

    Without a size it is the group's own number of cells; a group of more cells than the size is an error.
    """
    held = F.array_sort(F.collect_list(F.when(true_mask(mask), F.col(i))))
    n = F.col("_n") if size is None else F.when(F.col("_n") <= size, F.lit(size)).otherwise(F.raise_error(F.lit("a group has more cells than the size")).cast("int"))
    pad = F.array_repeat(F.lit(-1).cast("long"), n - F.size("_h"))
    return df.groupBy(*by).agg(held.alias("_h"), F.count("*").cast("int").alias("_n")).select(*by, F.concat("_h", pad).alias("inds"))


def one2nd(flat: Column, shape: list[int]) -> list[Column]:
    """Coordinates of a flat index, the first dimension fastest."""
    out, step = [], 1
    for n in shape:
        out.append(F.pmod(F.floor(flat / step), F.lit(n)).cast("long"))
        step *= n
    return out


def bounded(i: Column, size: int, boundary: str = "forbid") -> Column:
    """An index under a boundary rule: null beyond the ends for truncate, an error for forbid."""
    inside = (i >= 0) & (i < size)
    if boundary == "truncate":
        return F.when(inside, i)
    if boundary == "extend":
        return F.greatest(F.lit(0), F.least(F.lit(size - 1), i))
    if boundary == "periodic":
        return F.pmod(i, F.lit(size))
    if boundary == "mirror":
        j = F.pmod(i, F.lit(2 * size))
        return F.when(j < size, j).otherwise(2 * size - 1 - j)
    return F.when(inside, i).otherwise(F.raise_error(F.lit("index out of range")).cast("long"))


def index_nd(source: DataFrame, dims: list[str], v: str, probe: DataFrame, at: list[Column], shape: list[int], boundary: str = "forbid", out: str = "value") -> DataFrame:
    """Gather: each probe row gets the source cell at its coordinates, an equi-join on them."""
    keys = [f"_k{k}" for k in range(len(dims))]
    asked = probe.withColumns({k: bounded(c, n, boundary).cast("long") for k, c, n in zip(keys, at, shape, strict=True)})
    cells = source.select(*[F.col(d).cast("long").alias(k) for d, k in zip(dims, keys, strict=True)], F.col(v).alias(out))
    return asked.join(cells, keys, "left").drop(*keys)


def range_nd(source: DataFrame, dims: list[str], v: str, probe: DataFrame, at: list[str], size: list[int], shape: list[int], boundary: str = "truncate", out: str = "value") -> DataFrame:
    """Windows of ``size`` cells from each probe's corner, with offsets ``o0...``."""
    for k, n in enumerate(size):
        probe = probe.withColumn(f"o{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return index_nd(source, dims, v, probe, [F.col(c) + F.col(f"o{k}") for k, c in enumerate(at)], shape, boundary, out)


def slice_dim(df: DataFrame, i: str, start: int, stop: int, step: int | None = None, size: int | None = None) -> DataFrame:
    """Inclusive cut of a dimension, renumbered from 0; negative places count from the end, a start beyond the stop runs backward."""
    if size is not None:
        start, stop = (x + size if x < 0 else x for x in (start, stop))
    step = step or (1 if start <= stop else -1)
    lo, hi = min(start, stop), max(start, stop)
    if (step > 0) != (start <= stop) and start != stop:
        raise ValueError("step leads away from the stop")
    kept = df.where(F.col(i).between(lo, hi) & (F.pmod(F.col(i) - start, F.lit(abs(step))) == 0))
    return kept.withColumn(i, F.floor((F.col(i) - start) / step).cast("long"))


def dice(df: DataFrame, i: str, places: list[int]) -> DataFrame:
    """Cells at listed places of a dimension, in the list's order; places may repeat."""
    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for k, p in enumerate(places)])
    hit = F.filter(pairs, lambda x: x["p"] == F.col(i))
    return df.withColumn("_x", F.explode(hit)).withColumn(i, F.col("_x.k").cast("long")).drop("_x")


def diagonal(df: DataFrame, i: str, j: str) -> DataFrame:
    return df.where(F.col(i) == F.col(j)).drop(j)


def xchg(df: DataFrame, i: str, j: str) -> DataFrame:
    return df.withColumns({i: F.col(j), j: F.col(i)})


def reorder(df: DataFrame, dims: list[str], order: list[int]) -> DataFrame:
    """Dimension k becomes the one that was ``order[k]``."""
    return df.withColumns({d: F.col(dims[o]) for d, o in zip(dims, order, strict=True)})


def mv(df: DataFrame, dims: list[str], source: int, to: int) -> DataFrame:
    """A dimension moved to another place, those between shifted by one; negative places count from the end."""
    order = list(range(len(dims)))
    order.insert(to % len(dims), order.pop(source % len(dims)))
    return reorder(df, dims, order)


def squeeze(df: DataFrame, shape: dict[str, int]) -> DataFrame:
    """Without the dimensions of size 1."""
    return df.drop(*[d for d, n in shape.items() if n == 1])


def using(df: DataFrame, i: str, places: list[int]) -> list[DataFrame]:
    """The cells at each of some places of a dimension, as an array of its own."""
    return [df.where(F.col(i) == p).drop(i) for p in places]


def setbadat(df: DataFrame, dims: list[str], place: list[int], v: str) -> DataFrame:
    """One cell made missing."""
    hit = F.lit(True)
    for d, p in zip(dims, place, strict=True):
        hit = hit & (F.col(d) == p)
    return df.withColumn(v, F.when(~hit, F.col(v)))


def clump(df: DataFrame, i: str, j: str, size: int, out: str = "i0") -> DataFrame:
    flat = (F.col(i) + F.col(j) * size).cast("long")
    return df.withColumn("_f", flat).drop(i, j).withColumnRenamed("_f", out)


def splitdim(df: DataFrame, i: str, size: int, inner: str, outer: str) -> DataFrame:
    return df.withColumns({inner: F.pmod(F.col(i), F.lit(size)), outer: F.floor(F.col(i) / size)}).drop(*({i} - {inner, outer}))


def dummy(df: DataFrame, size: int, out: str) -> DataFrame:
    """A repeated dimension; each row is exploded in place, no join."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))


def dup(df: DataFrame, i: str, size: int, times: int) -> DataFrame:
    return dummy(df, times, "_t").withColumn(i, F.col(i) + F.col("_t") * size).drop("_t")


def dup_n(df: DataFrame, dims: dict[str, tuple[int, int]]) -> DataFrame:
    """Repeated along several dimensions, given as ``name: (size, times)``."""
    for i, (size, times) in dims.items():
        df = dup(df, i, size, times)
    return df


def inflate_n(df: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Each cell blown up to a block, of ``name: times`` along each dimension."""
    for i, times in dims.items():
        df = dummy(df, times, "_t").withColumn(i, F.col(i) * times + F.col("_t")).drop("_t")
    return df


def glue(parts: list[DataFrame], i: str, sizes: list[int]) -> DataFrame:
    """Parts behind one another on a dimension: side by side (augment) on the first, below one another (stack) on the second."""
    whole, at = parts[0], sizes[0]
    for p, n in zip(parts[1:], sizes[1:], strict=True):
        whole, at = append(whole, p, i, at), at + n
    return whole


def augment(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Cell matrices ``(i, j, v)`` side by side: columns behind columns."""
    return glue(parts, "j", sizes)


def mstack(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Cell matrices ``(i, j, v)`` below one another: rows behind rows."""
    return glue(parts, "i", sizes)


def append(a: DataFrame, b: DataFrame, i: str, size_a: int) -> DataFrame:
    """b behind a on one dimension."""
    return a.unionByName(b.withColumn(i, F.col(i) + size_a))


def cat(parts: list[DataFrame], out: str) -> DataFrame:
    """Parts stacked on a new last dimension."""
    whole = parts[0].withColumn(out, F.lit(0).cast("long"))
    for k, p in enumerate(parts[1:], 1):
        whole = whole.unionByName(p.withColumn(out, F.lit(k).cast("long")))
    return whole


def dog(df: DataFrame, i: str, size: int) -> list[DataFrame]:
    return [df.where(F.col(i) == k).drop(i) for k in range(size)]


def reshape(df: DataFrame, flat: str, v: str, size: int) -> DataFrame:
    """Cells by flat index cut to ``size`` or filled with 0 up to it."""
    grid = df.sparkSession.range(size).withColumnRenamed("id", flat)
    return grid.join(df.select(flat, F.col(v), F.lit(True).alias("_h")), flat, "left").select(flat, F.when(F.col("_h"), F.col(v)).otherwise(F.lit(0)).alias(v))


def insert(dst: DataFrame, src: DataFrame, dims: list[str], v: str, at: list[int]) -> DataFrame:
    """dst with src's cells written from a corner on: assignment to a slice, as a new relation."""
    moved = src.select(*[(F.col(d) + x).alias(d) for d, x in zip(dims, at, strict=True)], F.col(v).alias("_new"), F.lit(True).alias("_h"))
    return dst.join(moved, dims, "left").select(*dims, F.when(F.col("_h"), F.col("_new")).otherwise(F.col(v)).alias(v))


def squaretotri(df: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """Lower triangle packed row by row."""
    return df.where(F.col(i) <= F.col(j)).select((F.col(j) * (F.col(j) + 1) / 2 + F.col(i)).cast("long").alias("i0"), v)


def tritosquare(tri: DataFrame, v: str) -> DataFrame:
    """A packed lower triangle ``(i0, v)`` as cells ``(i, j, v)``; the other half is absent."""
    j = F.floor((F.sqrt(8 * F.col("i0") + 1) - 1) / 2)
    return tri.select((F.col("i0") - F.floor(j * (j + 1) / 2)).cast("long").alias("i"), j.cast("long").alias("j"), v)


def tritosym(df: DataFrame, i: str, j: str, v: str) -> DataFrame:
    """Both halves from the lower triangle."""
    low = df.where(F.col(i) <= F.col(j)).select(i, j, v)
    return low.unionAll(low.where(F.col(i) < F.col(j)).select(F.col(j).alias(i), F.col(i).alias(j), v))

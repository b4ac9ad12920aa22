"""Operators along an ordered dimension: sort ranks, running values, differences, runs, shifts.

``by`` names the broadcast dimensions (groups), ``order`` the columns that order cells within a group;
give enough of them to be unique, as order is never implied by storage.  Groups are scanned by a window, each
in one task.  Without ``by`` the table is one vector, which ``ranged`` scans in ranges: such calls run jobs,
as they write the ranges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cellgrid.operators import ranged, search, splines
from cellgrid.plans.shared import materialize


def window(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*ranged.keys_of(order))


def with_index(df: DataFrame, by: list[str], order: list[str], name: str = "i0", keep: list[str] | None = None) -> DataFrame:
    """Cells numbered from 0 within each group; without ``by`` of the columns in ``keep`` only, if it is given."""
    if not by:
        return ranged.indexed(df, order, name, keep)
    return df.withColumn(name, F.row_number().over(window(by, order)).cast("long") - 1)


def _cells(df: DataFrame, by: list[str]) -> Column:
    """The number of cells of each row's group."""
    return F.count("*").over(Window.partitionBy(*by)) if by else F.lit(df.count())


def _long_run(df: DataFrame, order: list[str], v: str, out: str, kind: str) -> DataFrame:
    return ranged.running(ranged.indexed(df, order), "_i", v, out, kind).drop("_i")


def cumusumover(df: DataFrame, by: list[str], order: list[str], v: str, out: str = "cumusum") -> DataFrame:
    """Running sum; a missing cell stays missing and does not restart it."""
    if not by:
        return _long_run(df, order, v, out, "sum").withColumn(out, F.when(F.col(v).isNotNull(), F.col(out)))
    run = window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(v).isNotNull(), F.sum(v).over(run)))


def cumuprodover(df: DataFrame, by: list[str], order: list[str], v: str, out: str = "cumuprod") -> DataFrame:
    if not by:
        return _long_run(df, order, v, out, "product").withColumn(out, F.when(F.col(v).isNotNull(), F.col(out)))
    run = window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(v).isNotNull(), F.product(v).over(run)))


def locf(df: DataFrame, by: list[str], order: list[str], v: str, out: str = "locf") -> DataFrame:
    """Last good value carried forward; before the first 0 for numbers, and null for all else."""
    start = F.lit(0) if isinstance(df.schema[v].dataType, NumericType) else F.lit(None)
    if not by:
        return _long_run(df, order, v, out, "last").withColumn(out, F.coalesce(out, start))
    run = window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.last(v, ignorenulls=True).over(run), start))


def numdiff(df: DataFrame, by: list[str], order: list[str], v: str, out: str = "numdiff") -> DataFrame:
    """Difference from the cell before; the first cell keeps its value."""
    if not by:
        seen = ranged.neighbours(ranged.indexed(df, order), "_i", {"_p": (v, -1)})
        return seen.withColumn(out, F.when(F.col("_i") == 0, F.col(v)).otherwise(F.col(v) - F.col("_p"))).drop("_i", "_p")
    return df.withColumn(out, F.col(v) - F.lag(v, 1, 0).over(window(by, order)))


def diff2(df: DataFrame, by: list[str], order: list[str], v: str, out: str = "diff2") -> DataFrame:
    """Difference from the last good cell before; the first cell of a group is dropped, a missing one stays missing."""
    if not by:
        seen = ranged.running(ranged.indexed(df, order), "_i", v, "_p", "last", before=True)
        return seen.withColumn(out, F.col(v) - F.coalesce("_p", F.lit(0))).where("_i > 0").drop("_i", "_p")
    w = window(by, order)
    prior = F.coalesce(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumns({out: F.col(v) - prior, "_first": F.row_number().over(w) == 1}).where("not _first").drop("_first")


def diffcentred(df: DataFrame, by: list[str], order: list[str], v: str, out: str = "diffcentred") -> DataFrame:
    """Half the difference of both neighbours, periodic at the ends."""
    if not by:
        n = df.count()
        held = ranged.neighbours(ranged.indexed(df, order), "_i", {"_a": (v, -1), "_b": (v, 1)})
        ends = {r["_i"]: r[v] for r in held.where(F.col("_i").isin(0, n - 1)).select("_i", v).collect()}
        a = F.when(F.col("_i") == 0, F.lit(ends.get(n - 1))).otherwise(F.col("_a"))
        b = F.when(F.col("_i") == n - 1, F.lit(ends.get(0))).otherwise(F.col("_b"))
        return held.withColumn(out, (b - a) / 2).drop("_i", "_a", "_b")
    w = window(by, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = F.row_number().over(w)
    n = F.count("*").over(whole)
    left = F.when(edge == 1, F.last(v).over(whole)).otherwise(F.lag(v).over(w))
    right = F.when(edge == n, F.first(v).over(whole)).otherwise(F.lead(v).over(w))
    return df.withColumn(out, (right - left) / 2)


def along(df: DataFrame, i: str, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns ``out: (scan, column)`` of one long vector whose cells ``i`` numbers from 0 without gaps, by one scan.

    The scans are ``cumusumover``, ``locf``, ``numdiff`` and ``diffcentred``, and give what these functions give.  The
    rows are read more than once, so they must be written ones, as ``with_index`` leaves them.
    """
    runs = {out: ("sum" if scan == "cumusumover" else "last", v, False) for out, (scan, v) in wanted.items() if scan in ("cumusumover", "locf")}
    back = {v: f"_a{k}" for k, v in enumerate(sorted({v for scan, v in wanted.values() if scan in ("numdiff", "diffcentred")}))}
    ahead = {v: f"_b{k}" for k, v in enumerate(sorted({v for scan, v in wanted.values() if scan == "diffcentred"}))}
    seen = ranged.scans(df, i, runs, {a: (v, -1) for v, a in back.items()} | {b: (v, 1) for v, b in ahead.items()})
    n, first, last = 0, {}, {}
    if ahead:
        ends = df.agg(F.max(i).alias("n"), *[f(v, i).alias(f"{b}{end}") for v, b in ahead.items() for end, f in (("first", F.min_by), ("last", F.max_by))]).first()
        n = 0 if ends["n"] is None else ends["n"] + 1
        first, last = ({v: F.lit(ends[f"{b}{end}"]) for v, b in ahead.items()} for end in ("first", "last"))
    start = lambda v: F.lit(0) if isinstance(df.schema[v].dataType, NumericType) else F.lit(None)
    at = F.col(i)
    of: dict[str, Callable[[str, str], Column]] = {
        "cumusumover": lambda out, v: F.when(F.col(v).isNotNull(), F.col(out)),
        "locf": lambda out, v: F.coalesce(out, start(v)),
        "numdiff": lambda out, v: F.when(at == 0, F.col(v)).otherwise(F.col(v) - F.col(back[v])),
        "diffcentred": lambda out, v: (F.when(at == n - 1, first[v]).otherwise(F.col(ahead[v])) - F.when(at == 0, last[v]).otherwise(F.col(back[v]))) / 2,
    }
    return seen.withColumns({out: of[scan](out, v) for out, (scan, v) in wanted.items()}).drop(*back.values(), *ahead.values())


def lags(df: DataFrame, by: list[str], order: list[str], v: str, step: int, count: int) -> DataFrame:
    """Columns lag0 (the cell itself) to lag<count - 1>, ``step`` apart; cells without all of them are dropped."""
    if not by:
        seen = ranged.neighbours(ranged.indexed(df, order), "_i", {f"lag{k}": (v, -k * step) for k in range(count)})
        return seen.where(F.col("_i") >= step * (count - 1)).drop("_i")
    w = window(by, order)
    out = df.withColumns({f"lag{k}": F.lag(v, k * step).over(w) if k else F.col(v) for k in range(count)})
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > step * (count - 1)).drop("_n")


def rotate(df: DataFrame, by: list[str], i: str, shift: int) -> DataFrame:
    """Circular shift of the index within each group, which is numbered from 0 without gaps."""
    return df.withColumn(i, F.pmod(F.col(i) + shift, _cells(df, by)))


def conv1d(df: DataFrame, by: list[str], i: str, v: str, kernel: list[float], reflect: bool = False, out: str = "conv1d") -> DataFrame:
    """Convolution with a short kernel centred at its middle, periodic at the ends unless ``reflect``.

    Each cell goes to the cells it bears on and one aggregation sums them: no join, and a map-side combine.
    """
    mid = (len(kernel) - 1) // 2
    held = df.select(*by, F.col(i).alias("_i"), F.col(v).alias("_v"), _cells(df, by).alias("_n"))
    if reflect:
        # a cell's value also stands at its mirror images just outside both ends
        spots = F.array(F.col("_i"), -F.col("_i") - 1, 2 * F.col("_n") - 1 - F.col("_i"))
        held = held.select(*by, "_v", "_n", F.explode(F.array_distinct(spots)).alias("_i"))
    taps = F.array(*[F.struct(F.lit(k - mid).alias("d"), F.lit(float(x)).alias("x")) for k, x in enumerate(kernel)])
    sent = held.select(*by, "_v", "_n", "_i", F.explode(taps).alias("t"))
    to = F.col("_i") + F.col("t.d")
    to = to if reflect else F.pmod(to, F.col("_n"))
    sums = sent.select(*by, to.alias(i), (F.col("_v") * F.col("t.x")).alias("_p"), "_n").where((F.col(i) >= 0) & (F.col(i) < F.col("_n")))
    return sums.groupBy(*by, i).agg(F.when(F.count("*") == F.count("_p"), F.sum("_p")).alias(out))


def partial(df: DataFrame, by: list[str], order: list[str], v: str, direction: str = "c", out: str = "partial") -> DataFrame:
    """Derivative at unit spacing: ``c`` centred and periodic, ``f`` difference from the cell before, ``b`` from the cell behind
    (in backward order), ``p`` monotone cubic, ``s`` cubic spline.  The last two hold a group in memory; without groups
    they work in ranges, and missing cells are left out of the curve."""
    if direction == "c":
        return diffcentred(df, by, order, v, out)
    if direction == "f":
        return numdiff(df, by, order, v, out)
    if direction == "b":
        held = with_index(df, by, [F.col(c).desc() for c in order], "_b")
        return numdiff(held, by, ["_b"], v, out).drop("_b")
    if not by:
        held = materialize(ranged.indexed(df, order), "indexed")
        found = splines.slopes(held.select("_i", v), "_i", v, {"p": "pchip", "s": "spline"}[direction])
        found = found.select(F.col("x").cast("long").alias("_i"), F.col("d").alias(out))
        return held.join(found, "_i", "left").drop("_i")
    slopes = {"p": search.pchip_slopes, "s": search.spline_slopes}[direction]

    def each(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        y = g[v].to_numpy(float)
        return g.assign(**{out: slopes(np.arange(len(y), dtype=float), y) if len(y) > 1 else np.zeros(len(y))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double"
    return df.groupBy(*by).applyInPandas(each, schema)


def intover(df: DataFrame, by: list[str], i: str, v: str, out: str = "integral") -> DataFrame:
    """Integral at unit spacing: closed Newton-Cotes rules up to five cells, end-corrected sums beyond."""
    # Weights of the closed rules and of the ends of longer vectors.
    rules = {1: [0.0], 2: [1 / 2, 1 / 2], 3: [1 / 3, 4 / 3, 1 / 3], 4: [3 / 8, 9 / 8, 9 / 8, 3 / 8], 5: [14 / 45, 64 / 45, 24 / 45, 64 / 45, 14 / 45]}
    ends = [3 / 8, 7 / 6, 23 / 24]
    held = df.select(*by, F.col(i).alias("_i"), F.col(v).alias("_v"), _cells(df, by).alias("_n"))
    near = F.least(F.col("_i"), F.col("_n") - 1 - F.col("_i")) + 1
    weight = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in ends]), near.cast("int")), F.lit(1.0))
    for size, rule in rules.items():
        weight = F.when(F.col("_n") == size, F.try_element_at(F.array(*[F.lit(x) for x in rule]), (F.col("_i") + 1).cast("int"))).otherwise(weight)
    return held.groupBy(*by).agg(F.sum(F.col("_v") * weight).alias(out))


# order statistics ----------------------------------------------------------------------------------


def qsorti(df: DataFrame, by: list[str], v: str, ties: list[str], out: str = "rank") -> DataFrame:
    """Place of each cell in ascending order, missing last, ties by ``ties``."""
    order = [F.col(v).isNull(), F.isnan(F.col(v).cast("double")), F.col(v), *[F.col(c) for c in ties]]
    if not by:
        return ranged.indexed(df, order, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)


def qsortveci(df: DataFrame, by: list[str], columns: list[str], ties: list[str], out: str = "rank") -> DataFrame:
    """Place of each vector, held in columns, in lexicographic order; vectors with a missing element last."""
    bad = F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))
    order = [bad, *[F.col(c).asc_nulls_last() for c in [*columns, *ties]]]
    if not by:
        return ranged.indexed(df, order, out)
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)


def extreme_n(df: DataFrame, by: list[str], v: str, i: str, n: int, largest: bool = True) -> DataFrame:
    """The n largest (or smallest) cells of each group with ``nth`` from 0; ties by index.

    The row-number filter is pushed into the window as a group limit, so each task keeps n rows a group.
    """
    first = F.col(v).desc_nulls_last() if largest else F.col(v).asc_nulls_last()
    ranked = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))).withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(first, i)))
    return ranked.where(F.col("nth") <= n).withColumn("nth", F.col("nth").cast("long") - 1)


def pctover(df: DataFrame, by: list[str], v: str, places: dict[str, float]) -> DataFrame:
    """Percentiles of each group's good values, by name, linear between neighbours at place (n - 1) p; p is clamped to 0..1."""
    at = lambda p: lambda n: (n - 1) * min(1.0, max(0.0, p))
    asked = {f"_{side}{k}": (lambda n, f=f, p=p: f(at(p)(n))) for k, p in enumerate(places.values()) for side, f in (("lo", F.floor), ("hi", F.ceil))}
    found = ranged.values_at(df.withColumn("_x", F.col(v).cast("double")), by, "_x", asked)
    part = lambda p: at(p)(F.col("_total")) - F.floor(at(p)(F.col("_total")))
    return found.select(*by, *[(F.col(f"_lo{k}") + F.when(part(p) > 0, part(p) * (F.col(f"_hi{k}") - F.col(f"_lo{k}"))).otherwise(0.0)).alias(name) for k, (name, p) in enumerate(places.items())])


def medover(df: DataFrame, by: list[str], v: str, out: str = "med") -> DataFrame:
    return pctover(df, by, v, {out: 0.5})


def oddpctover(df: DataFrame, by: list[str], v: str, p: float, out: str = "oddpct", median: bool = False) -> DataFrame:
    """The value at place floor(n p) of each group's sorted good values, clamped; with ``median`` the lower middle one."""
    place = (lambda n: F.floor((n - 1) / 2)) if median else (lambda n: F.greatest(F.least(n - 1, F.floor(n * p)), F.lit(0)))
    return ranged.values_at(df, by, v, {out: place}).select(*by, out)


def modeover(df: DataFrame, by: list[str], v: str, out: str = "mode") -> DataFrame:
    """Most frequent whole value, the smallest of ties; 0 if no value repeats in a group of several distinct ones."""
    counts = df.groupBy(*by, F.col(v).cast("bigint").alias("_v")).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*by).agg(F.max(F.struct("_n", (-F.col("_v")).alias("_m"))).alias("_b"))
    return best.select(*by, F.when(F.col("_b._n") > 1, -F.col("_b._m")).otherwise(F.lit(0)).cast("long").alias(out))


def statsover(df: DataFrame, by: list[str], v: str, w: str | None = None) -> DataFrame:
    """avg, prms, med, vmin, vmax, adev and rms of each group, weighted by ``w`` (unit weights without).

    The mean is a first aggregate that joins back for deviations; groups meet on their keys, and adaptive
    execution may split a large one as neither side of the join is ordered within a group.
    """
    x = df.select(*by, F.col(v).cast("double").alias("_v"), (F.col(w).cast("double") if w else F.lit(1.0)).alias("_w")).where("_v is not null and _w is not null")
    means = x.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_m"))
    both = ranged.same_keys(x, means, by) if by else x.crossJoin(F.broadcast(means))  # one row
    d = F.col("_v") - F.col("_m")
    sw = F.sum("_w")
    square = F.sum(F.col("_w") * d * d)
    prms = F.when(sw > 1, F.sqrt(square / F.when(sw > 1, sw - 1))).otherwise(0.0)
    sums = both.groupBy(*by).agg(F.first("_m").alias("avg"), prms.alias("prms"), F.min("_v").alias("vmin"), F.max("_v").alias("vmax"), (F.sum(F.col("_w") * F.abs(d)) / sw).alias("adev"), F.sqrt(square / sw).alias("rms"))
    return _with_median(sums, x, by, "_v").select(*by, "avg", "prms", "med", "vmin", "vmax", "adev", "rms")


def stats(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """avg, prms, med, vmin, vmax and rms of each group with unit weights."""
    x = F.col(v).cast("double")
    prms = F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(0.0)
    sums = df.groupBy(*by).agg(F.avg(x).alias("avg"), prms.alias("prms"), F.min(x).alias("vmin"), F.max(x).alias("vmax"), F.stddev_pop(x).alias("rms"))
    return _with_median(sums, df, by, v).select(*by, "avg", "prms", "med", "vmin", "vmax", "rms")


def _with_median(sums: DataFrame, df: DataFrame, by: list[str], v: str) -> DataFrame:
    med = medover(df, by, v)
    return ranged.same_keys(sums, med, by, "left") if by else sums.crossJoin(F.broadcast(med))  # one row


# runs ----------------------------------------------------------------------------------------------


def _long_islands(df: DataFrame, order: list[str], v: str, new: Callable[[Column], Column]) -> DataFrame:
    """One vector with ``run``, numbered from 0, where ``new`` says of the value before whether a run begins."""
    seen = ranged.neighbours(ranged.indexed(df, order), "_i", {"_p": (v, -1)})
    marked = seen.withColumn("_new", F.when(F.col("_i") == 0, 0).otherwise(F.coalesce(new(F.col("_p")).cast("int"), F.lit(1))))
    return ranged.running(marked, "_i", "_new", "run").withColumn("run", F.col("run").cast("long"))


def _islands(df: DataFrame, by: list[str], order: list[str], new: Column) -> DataFrame:
    w = window(by, order)
    return df.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def rle(df: DataFrame, by: list[str], order: list[str], v: str) -> DataFrame:
    """Runs of equal values: ``run`` from 0, ``len`` and ``value``."""
    if not by:
        held = _long_islands(df, order, v, lambda p: ~F.col(v).eqNullSafe(p))
        return held.groupBy("run").agg(F.count("*").alias("len"), F.first(v).alias("value"))
    new = (~F.col(v).eqNullSafe(F.lag(v).over(window(by, order)))).cast("int")
    first = F.row_number().over(window(by, order)) == 1
    marked = _islands(df, by, order, F.when(first, 0).otherwise(new))
    return marked.groupBy(*by, "run").agg(F.count("*").alias("len"), F.first(v).alias("value"))


def rld(df: DataFrame, by: list[str], run: str = "run", length: str = "len", value: str = "value") -> DataFrame:
    """Cells of encoded runs, numbered ``i0`` from 0 in each group; runs of length 0 give none."""
    if by:
        start = F.sum(length).over(window(by, [run]).rowsBetween(Window.unboundedPreceding, -1))
    else:
        df, start = ranged.running(ranged.indexed(df, [run]), "_i", length, "_s", before=True), F.col("_s")
    start = F.coalesce(start, F.lit(0))
    spans = df.select(*by, F.col(value).alias("value"), start.alias("_s"), F.col(length).alias("_n")).where("_n > 0")
    return spans.select(*by, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_n") - 1)).alias("i0"), "value")


def rleseq(df: DataFrame, by: list[str], order: list[str], v: str) -> DataFrame:
    """Runs that rise by one: ``run`` from 0, ``len`` and ``start``."""
    if not by:
        held = _long_islands(df, order, v, lambda p: F.col(v) != p + 1)
        return held.groupBy("run").agg(F.count("*").alias("len"), F.min(v).alias("start"))
    w = window(by, order)
    first = F.row_number().over(w) == 1
    marked = _islands(df, by, order, F.when(first, 0).otherwise((F.col(v) != F.lag(v).over(w) + 1).cast("int")))
    return marked.groupBy(*by, "run").agg(F.count("*").alias("len"), F.min(v).alias("start"))


def rlevec(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Runs of equal vectors held in columns: ``run`` from 0, ``len`` and the columns."""
    return rle(df.withColumn("_vec", F.struct(*columns)), by, order, "_vec").select(*by, "run", "len", "value.*")


def rldvec(df: DataFrame, by: list[str], columns: list[str], run: str = "run", length: str = "len") -> DataFrame:
    """Cells of encoded vectors, numbered ``i0`` from 0 in each group."""
    return rld(df.withColumn("_vec", F.struct(*columns)), by, run, length, "_vec").select(*by, "i0", "value.*")


def rldseq(df: DataFrame, by: list[str], run: str = "run", length: str = "len", start: str = "start") -> DataFrame:
    return df.where(F.col(length) > 0).select(*by, run, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)).alias("value"))


def enumvec(df: DataFrame, by: list[str], key: list[str], ties: list[str], out: str = "k") -> DataFrame:
    """Counter from 0 within equal keys."""
    return df.withColumn(out, F.row_number().over(window([*by, *key], ties)).cast("long") - 1)


def enumvecg(df: DataFrame, by: list[str], key: list[str], out: str = "k") -> DataFrame:
    """Number from 0 of each distinct key, in order: keys are made distinct, ranked and joined back."""
    ranked = with_index(df.select(*by, *key).distinct(), by, key, out)
    return ranged.same_keys(df, ranked, [*by, *key])

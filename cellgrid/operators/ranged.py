"""Scans of one long vector, in parallel.

Rows are dealt into ranges of their order (or into chunks of their index), each task scans one, and what lies
before a range is carried into it: one row per range reaches the driver.  No window covers the whole vector.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellgrid.plans.shared import materialize

# Rows of a chunk: a task holds one, and the driver one carried row for each.
CHUNK = 1 << 20
# Distinct values up to which, all groups together, they are scanned by a window over each group.
FEW_VALUES = 1 << 20


def keys_of(order: list) -> list[Column]:
    """Sort keys, missing last."""
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Join on keys of which missing ones are equal; the right side's are dropped."""
    named = right.withColumnsRenamed({k: f"_key{n}" for n, k in enumerate(keys)})
    on = fold(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(keys)])
    joined = left.join(named, on, how)
    return joined if how == "left_semi" else joined.drop(*[f"_key{n}" for n in range(len(keys))])


def ranges(df: DataFrame, order: list) -> DataFrame:
    """The rows with ``_r``, the number of the range of ``order`` they are in; as many ranges as shuffle partitions.

    Spark finds the limits from a sample, and the layout is written, so it cannot change between scans.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *keys_of(order)).withColumn("_r", F.spark_partition_id()), "ranges")


def carried(sums: DataFrame, step: Callable, start: object, place: str) -> DataFrame:
    """For rows ``(place, _t)`` what ``step`` makes of all earlier ``_t``, as a small table ``(place, _before)``."""
    out, now = [], start
    for at, t in sorted(sums.collect()):
        out.append((at, now))
        now = step(now, t)
    kind = StructType([sums.schema[place], StructField("_before", sums.schema["_t"].dataType)])
    return F.broadcast(sums.sparkSession.createDataFrame(out, kind))  # a row per range or chunk


def indexed(df: DataFrame, order: list, name: str = "_i", keep: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 in the given order; ties in any order.  With ``keep`` only these columns stay.

    Each range is sorted as it is written, and places within it go along, so nothing is dealt out again to number
    them, and keys that are not kept are not written.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys_of(order)).sortWithinPartitions(*keys_of(order))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    held = materialize(dealt.withColumns({"_r": F.spark_partition_id(), "_p": place}).select(*(df.columns if keep is None else keep), "_r", "_p"), "ranges")
    before = carried(held.groupBy("_r").agg(F.count("*").alias("_t")), lambda a, b: a + b, 0, "_r")
    return held.join(before, "_r").withColumn(name, F.col("_p") + F.col("_before")).drop("_r", "_p", "_before")


def neighbours(df: DataFrame, i: str, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Columns ``out: (column, distance)`` from the rows at fixed distances of the index; null beyond the ends."""
    return scans(df, i, {}, wanted)


KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    # how a chunk is folded, how two folds are put together on the driver, and in a column
    "sum": (F.sum, lambda a, b: b if a is None else a if b is None else a + b, lambda a, b: F.coalesce(a + b, a, b)),
    "product": (F.product, lambda a, b: b if a is None else a if b is None else a * b, lambda a, b: F.coalesce(a * b, a, b)),
    "last": (lambda v: F.last(v, ignorenulls=True), lambda a, b: a if b is None else b, lambda a, b: F.coalesce(b, a)),
}


def running(df: DataFrame, i: str, v: str, out: str, kind: str = "sum", before: bool = False) -> DataFrame:
    """Running fold of ``v`` along the index, missing cells left out; of the cells before only, with ``before``."""
    return scans(materialize(df, "chunks"), i, {out: (kind, v, before)}, {})


def scans(df: DataFrame, i: str, runs: dict[str, tuple[str, str, bool]], near: dict[str, tuple[str, int]]) -> DataFrame:
    """Running folds ``out: (kind, column, of the cells before only)`` and columns ``out: (column, distance)`` from
    rows at fixed distances (null beyond the ends) along the index, all by one scan of each chunk.

    Chunks hold copies of the few rows at their borders that others need.  With folds the rows are read twice, so
    they must be written ones.
    """
    back, ahead = max([0, *(-d for _, d in near.values())]), max([0, *(d for _, d in near.values())])
    home = F.floor(F.col(i) / CHUNK).cast("long")
    homes = F.sequence(F.floor(F.greatest(F.col(i) - ahead, F.lit(0)) / CHUNK), F.floor((F.col(i) + back) / CHUNK))
    spread = df.withColumn("_c", F.explode(homes) if near else home)
    w = Window.partitionBy("_c").orderBy(i)
    seen = {out: F.lag(c, -d).over(w) if d < 0 else F.lead(c, d).over(w) for out, (c, d) in near.items()}
    sums = []
    for k, (out, (kind, v, before)) in enumerate(runs.items()):
        whole = KINDS[kind][0]
        last = F.max_by(v, F.when(F.col(v).isNotNull(), F.col(i)))
        sums.append((last if kind == "last" else whole(v)).alias(f"_t{k}"))
        own = F.when(F.col("_c") == home, F.col(v)) if near else F.col(v)
        seen[out] = whole(own).over(w.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    scanned = spread.withColumns(seen)
    scanned = scanned.where(F.col("_c") == home) if near else scanned
    if not runs:
        return scanned.drop("_c")
    together = [KINDS[kind][1] for kind, _, _ in runs.values()]
    totals = df.groupBy(home.alias("_c")).agg(F.struct(*sums).alias("_t"))
    prior = carried(totals, lambda now, t: [f(a, b) for f, a, b in zip(together, now, t, strict=True)], [None] * len(runs), "_c")
    joined = scanned.join(prior, "_c")
    return joined.withColumns({out: KINDS[kind][2](F.col(f"_before._t{k}"), F.col(out)) for k, (out, (kind, _, _)) in enumerate(runs.items())}).drop("_c", "_before")


def values_at(df: DataFrame, by: list[str], v: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group ``_total``, its good values, and the value at each place (from 0, of the total) in their order.

    Distinct values are counted first.  If they are more than FEW_VALUES, their counts are dealt into ranges of
    group and value, of which only those that hold a place are scanned, so no group and no value is too large for
    a task.
    """
    counts = df.where(F.col(v).isNotNull()).groupBy(*by, F.col(v).alias("_v")).agg(F.count("*").alias("_n"))
    if by:
        counts = materialize(counts, "counts")
        if counts.count() <= FEW_VALUES:
            every = Window.partitionBy(*by)
            scanned = counts.withColumns({"_u": F.sum("_n").over(every.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("_n").over(every)})
            at = lambda f: f(F.col("_total")).cast("long")
            hit = lambda f: F.max(F.when((at(f) < F.col("_u")) & (at(f) >= F.col("_u") - F.col("_n")), F.col("_v")))
            return scanned.groupBy(*by).agg(F.max("_total").alias("_total"), *[hit(f).alias(name) for name, f in places.items()])
    held = ranges(counts, [*by, "_v"])
    sums = held.groupBy(*by, "_r").agg(F.sum("_n").alias("_t"))
    if by:
        w = Window.partitionBy(*by)  # over a group's ranges, at most as many as there are
        spans = sums.withColumns({"_before": F.coalesce(F.sum("_t").over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_t").over(w)})
    else:
        total = sums.agg(F.coalesce(F.sum("_t"), F.lit(0))).first()[0]
        spans = sums.join(carried(sums, lambda a, b: a + b, 0, "_r"), "_r").withColumn("_total", F.lit(total))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("_total")).cast("long").alias("place")) for name, f in places.items()])
    inside = lambda x: (x["place"] >= F.col("_before")) & (x["place"] < F.col("_before") + F.col("_t"))
    hits = materialize(spans.select(*by, "_r", "_before", "_total", F.filter(asked, inside).alias("_asked")).where(F.size("_asked") > 0), "places")
    keys = [*by, "_r"]
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    scanned = same_keys(held, hits, keys, "left_semi").withColumn("_upto", upto)
    one = same_keys(scanned, hits, keys).select(*by, "_v", "_total", "_n", (F.col("_before") + F.col("_upto")).alias("_u"), F.explode("_asked").alias("_a"))
    found = one.where((F.col("_a.place") < F.col("_u")) & (F.col("_a.place") >= F.col("_u") - F.col("_n")))
    return found.groupBy(*by).agg(F.max("_total").alias("_total"), *[F.max(F.when(F.col("_a.name") == name, F.col("_v"))).alias(name) for name in places])

"""Text columns: readers and writers over Spark's own text sources."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize


def rcols(spark: SparkSession, path: str, names: list[str], columns: list[int] | None = None, sep: str = r"\s+", exclude: str = r"^#|^\s*$", include: str | None = None, types: list[str] | None = None, undef: float | None = 0.0, lines: str | None = None, colids: bool = False) -> DataFrame:
    """Columns of a text file as numbers.

    Lines matching ``exclude`` (comments and blank ones) or not matching ``include`` are left out; an empty or
    unreadable field of a number becomes ``undef``.  Types default to double.

    ``lines`` "a:b" or "a:b:c" keeps lines a to b of each file, numbered from 0 with all that is left out, or from -1
    at the end backwards; in turned order if a comes after b; and of these that are not left out every c-th.  The result then
    has ``nth``, a row's place in that order.  With ``colids`` the first line holds names, see ``column_ids``: it is no row
    and has no number.  More files than one have an order of their own each.
    """
    matching = ~F.col("value").rlike(exclude)
    if include:
        matching &= F.col("value").rlike(include)
    if lines is None and not colids:
        kept, order = spark.read.text(path).where(matching), []
    else:
        kept, order = _picked(spark, path, matching, lines, colids), ["nth"] if lines is not None else []
    fields = F.split(F.trim("value") if sep == r"\s+" else F.col("value"), sep)
    out = []
    for k, name in enumerate(names):
        at = columns[k] if columns else k
        kind = types[k] if types else "double"
        raw = F.try_element_at(fields, F.lit(at + 1))
        value = raw if kind == "string" else F.trim(raw).try_cast(kind)
        out.append((value if kind == "string" or undef is None else F.coalesce(value, F.lit(undef).cast(kind))).alias(name))
    return kept.select(*order, *out)


def column_ids(spark: SparkSession, path: str, sep: str = r"\s+") -> list[str]:
    """The fields of a file's first line."""
    begin = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    first = begin.select(F.split(F.trim("value") if sep == r"\s+" else F.col("value"), sep)).first()
    return list(first[0]) if first else []


def _numbered(lines: DataFrame, name: str) -> DataFrame:
    """``lines`` with their number from 0 in each file: counts of blocks are added up, and a window numbers one block."""
    counts = lines.groupBy("_file", "_block").agg(F.count("*").alias("_n"))
    prior = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_id")) - 1
    both = lines.withColumn("_inside", inside).join(before, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return both.withColumn(name, F.col("_before") + F.col("_inside")).drop("_f", "_b", "_before", "_inside")


def _picked(spark: SparkSession, path: str, matching: Column, lines: str | None, colids: bool) -> DataFrame:
    """``(value, nth)`` of the lines that a pattern of line numbers takes.

    The blocks that Spark reads a file in are known by where they begin; lines and their order in a block are written once,
    so that every number comes from one reading.
    """
    found = re.fullmatch(r"\s*([+-]?\d*)\s*:\s*([+-]?\d*)\s*(?::\s*(\d*)\s*)?", lines or ":")
    if not found or found[3] and int(found[3]) < 1:
        raise ValueError(f"no line numbers: {lines!r}")
    a, b, step = int(found[1] or 0), int(found[2] or -1), int(found[3] or 1)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    held = _numbered(materialize(raw, "lines", "zstd"), "_line")
    if colids:
        held = held.where("_line > 0").withColumn("_line", F.col("_line") - 1)
    turned = a > b if (a < 0) == (b < 0) else a < 0
    low, high = (b, a) if turned else (a, b)
    totals = held.groupBy(F.col("_file").alias("_f")).agg((F.max("_line") + 1).alias("_total"))
    limit = lambda x: F.lit(x) + (F.col("_total") if x < 0 else 0)
    # the step is counted from the first line wanted, or from the file's if that is told from the end
    asked = _numbered(held.where(matching & (F.col("_line") >= max(low, 0))), "_match").where(F.col("_match") % step == 0)
    inside = asked.join(totals, F.col("_file") == F.col("_f")).where(F.col("_line").between(limit(low), limit(high)))
    ranked = _numbered(inside.drop("_f", "_total"), "_rank")
    if not turned:
        return ranked.select("value", F.col("_rank").alias("nth"))
    last = ranked.groupBy(F.col("_file").alias("_f")).agg(F.max("_rank").alias("_last"))
    return ranked.join(last, F.col("_file") == F.col("_f")).select("value", (F.col("_last") - F.col("_rank")).alias("nth"))


def _line(columns: list[str], fmt: str | None, sep: str) -> Column:
    return F.format_string(fmt, *columns) if fmt else F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def swcols(df: DataFrame, columns: list[str], fmt: str | None = None, sep: str = " ") -> DataFrame:
    """One text ``line`` per row."""
    return df.select(_line(columns, fmt, sep).alias("line"))


def wcols(df: DataFrame, columns: list[str], path: str, fmt: str | None = None, sep: str = " ", mode: str = "errorifexists") -> None:
    swcols(df, columns, fmt, sep).write.mode(mode).text(path)


def rgrep(spark: SparkSession, path: str, pattern: str, names: list[str], kind: str = "double") -> DataFrame:
    """A column for each group of a pattern, from the lines that match."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, k + 1).try_cast(kind).alias(n) for k, n in enumerate(names)])


def rasc(spark: SparkSession, path: str) -> DataFrame:
    """All white-space separated numbers of each line: ``nums`` with ``ierr`` 1 where a field is none."""
    field = F.explode(F.filter(F.split("value", r"\s+"), lambda x: x != ""))
    return spark.read.text(path).select(field.alias("f")).select(F.coalesce(F.col("f").try_cast("double"), F.lit(0.0)).alias("nums"), F.col("f").try_cast("double").isNull().cast("int").alias("ierr"))


def rcube(spark: SparkSession, paths: list[str], names: list[str]) -> DataFrame:
    """Files of one layout stacked on a new dimension ``file``, in the order given."""
    out = None
    for k, path in enumerate(paths):
        part = rcols(spark, path, names).withColumn("file", F.lit(k).cast("long"))
        out = part if out is None else out.unionAll(part)
    return out

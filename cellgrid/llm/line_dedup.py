"""Site-relative line removal in Spark's own functions: lines on many of a site's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

RATIO = 0.1
MIN_PAGES = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0


def boilerplate(docs: DataFrame, site: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(site, no_site, bad)``: hashes of the lines on over ``ratio`` of a site's pages and on ``min_pages`` at least.

    A site has at most its mean lines a page, divided by ratio, of them, so the array is small at any size.
    A null site is a site of its own.
    """
    pages = docs.select(site.alias("site"), F.array_distinct(F.transform(F.filter(_lines(text), _has_word), lambda x: F.xxhash64(x))).alias("lines"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    counts = pages.select("site", F.explode("lines").alias("line")).groupBy("site", "line").agg(F.count("*").alias("holding"))
    often = materialize(counts.where(F.col("holding") >= min_pages), "often-lines")
    totals = materialize(totals, "site-pages")
    met = often.alias("o").join(totals.alias("t"), F.col("o.site").eqNullSafe(F.col("t.site"))).where(F.col("holding") > F.lit(ratio) * F.col("pages"))
    bad = met.groupBy(F.col("o.site").alias("site")).agg(F.collect_list("line").alias("bad"))
    return bad.select(F.coalesce("site", F.lit("")).alias("site"), F.col("site").isNull().alias("no_site"), "bad")


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, site: Column | None = None) -> DataFrame:
    """The input's rows in struct ``row`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines are what ``\\n`` parts.  For each site, pages (rows) that hold a line are divided by the site's
    pages; lines beyond ``ratio`` that ``min_pages`` pages hold at least go from all of the site's pages,
    every time they occur.  Lines without a word always stay, and so do all rows.  Null text is empty: one
    line without a word.  Repeated rows count as pages of their own; ids are not used; an empty table
    gives no rows; clashing names are safe inside ``row``.  ``site`` may be any column, such as a URL's host.
    """
    at = F.col(site_col) if site is None else site
    bad = materialize(boilerplate(docs, at, F.col(text_col), ratio, min_pages), "boilerplate")
    rows = docs.select(F.coalesce(at, F.lit("")).alias("site"), at.isNull().alias("no_site"), F.struct("*").alias("row"))
    both = rows.join(bad, ["site", "no_site"], "left")
    lines = _lines(F.col(f"row.{text_col}"))
    own = F.array_intersect(F.transform(lines, lambda x: F.xxhash64(x)), F.col("bad"))
    found = both.select("row", F.coalesce(own, F.array().cast("array<bigint>")).alias("own"))
    kept = F.filter(lines, lambda x: ~(_has_word(x) & F.array_contains(F.col("own"), F.xxhash64(x))))
    cut = found.select("row", lines.alias("lines"), F.when(F.size("own") == 0, lines).otherwise(kept).alias("kept"))
    return cut.select("row", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))

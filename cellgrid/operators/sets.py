"""Distinct values and set operations on one-dimensional data or whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uniq(df: DataFrame, v: str) -> DataFrame:
    """Distinct good values; every NaN stays."""
    held = df.select(v).where(F.col(v).isNotNull())
    nan = F.isnan(F.col(v).cast("double"))
    return held.where(~nan).distinct().unionAll(held.where(nan))


def uniqind(df: DataFrame, v: str, i: str) -> DataFrame:
    """The last index of each distinct good value."""
    return df.where(F.col(v).isNotNull()).groupBy(v).agg(F.max(i).alias("ind"))


def uniqvec(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct rows; rows of missing cells only are dropped."""
    return df.select(*cols).dropna(how="all").distinct()


def setops(a: DataFrame, op: str, b: DataFrame) -> DataFrame:
    """OR, AND or XOR of two sets of rows with one schema; repeats count once."""
    if op == "OR":
        return a.unionAll(b).distinct()
    if op == "AND":
        return a.intersect(b)
    if op == "XOR":
        both = a.distinct().withColumn("_s", F.lit(1)).unionAll(b.distinct().withColumn("_s", F.lit(2)))
        return both.groupBy(*a.columns).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    raise ValueError(f"unknown set operation {op}")


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def is_member(df: DataFrame, v: str, values: DataFrame, column: str, out: str = "in") -> DataFrame:
    """1 where ``v`` is among another table's values, else 0; an outer join on distinct keys, so rows are not repeated."""
    keys = values.select(F.col(column).alias("_k")).where("_k is not null").distinct()
    return df.join(keys, F.col(v) == F.col("_k"), "left").withColumn(out, F.col("_k").isNotNull().cast("int")).drop("_k")

"""Where queries are registered, and the tables they start from.

lineitem is an array per order whose cells are ordered by ``ORDER``; events is one per user, ordered by time;
embeddings holds packed vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators import sequences

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
SQL_ORDER = ", ".join(ORDER)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """lineitem with the cell index ``i0``."""
    return sequences.with_index(read(spark, d, "lineitem"), ["l_orderkey"], ORDER).select("l_orderkey", "i0", *columns)


def events(spark: SparkSession, d: str) -> DataFrame:
    return sequences.with_index(read(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"])


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def r_binary(c: Column, digits: int = 6) -> Column:
    """Doubles rounded as DuckDB's ``round`` does, through the double 10**digits times the value; ``r`` goes by the
    value's shortest decimals.  They part at ties, as where a binary fraction ends just behind the last digit."""
    scaled = c.cast("double") * 10.0**digits
    rounded = F.round(scaled, 0) / 10.0**digits
    return F.when(F.isnan(rounded) | (F.abs(scaled) == F.lit(float("inf"))), c).otherwise(rounded)


ITEMS = f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER}) - 1 AS i0 FROM lineitem)"
EVENTS = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i0 FROM events)"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The packed vectors as doubles."""
    return read(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))

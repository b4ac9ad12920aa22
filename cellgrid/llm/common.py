"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what separates words, in every operator.
SPACE = r"\x20\x09-\x0D"


# Texts are long, so Arrow's usual batches of 10,000 rows would hold too much of an executor's memory.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches that suit long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in a session with small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as a long (null: 0), in Spark's own expressions."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def column(name: str) -> Column:
    """A column by its own name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")

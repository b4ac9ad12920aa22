"""Streaming forms of reductions: results that follow a growing parent, as dataflow does for arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_stats(stream: DataFrame, time: str, by: list[str], v: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, sum, extremes and mean per group and tumbling window; late rows are dropped after ``late``, which bounds the state."""
    return _timed(stream, time, late).groupBy(F.window(time, width), *by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.avg(v).alias("avg")).select(F.col("window.start").alias("start"), *by, "n", "total", "vmin", "vmax", "avg")


def windowed_histogram(stream: DataFrame, time: str, v: str, step: float, low: float, bins: int, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    from cellgrid.operators.histograms import bin_of

    keyed = _timed(stream, time, late).where(F.col(v).isNotNull()).withColumn("bin", bin_of(F.col(v), step, low, bins))
    return keyed.groupBy(F.window(time, width), "bin").agg(F.count("*").alias("hist")).select(F.col("window.start").alias("start"), "bin", "hist")


def running_sum(stream: DataFrame, key: str, order: str, v: str) -> DataFrame:
    """Running sum per key across micro-batches, with one number of state per key.

    Rows of a batch are taken in ``order`` within the key; a missing value leaves the sum as it is.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        sums = total + rows[v].fillna(0.0).cumsum()
        state.update((float(sums.iloc[-1]),))
        yield pd.DataFrame({key: rows[key], order: rows[order], "cumusum": sums.where(rows[v].notna())})

    schema = f"`{key}` {kind}, `{order}` {stream.schema[order].dataType.simpleString()}, cumusum double"
    return stream.select(key, order, v).groupBy(key).applyInPandasWithState(step, schema, "total double", "append", GroupStateTimeout.NoTimeout)

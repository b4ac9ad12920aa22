"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_HELD: ContextVar[list[str] | None] = ContextVar("held", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a laptop) a local-mode session gets a temporary folder once;
    any other master must name one, as executors cannot see the driver's disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = getattr(sc, "_cellgrid_shared", None)
    if found is None:
        found = sc._cellgrid_shared = tempfile.mkdtemp(prefix="cellgrid-")
    return found


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cellgrid/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives lost executors, ends the lineage, and has exact size statistics, so the
    planner broadcasts it only when it really is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write
    if compression:
        writer = writer.option("compression", compression)
    writer.parquet(path)
    held = _HELD.get()
    if held is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``materialize`` writes within are deleted at the end, but for those taken off the list.

    A result must be written before that, as nothing that reads these tables can be run afterwards.  Queries
    that return a DataFrame leave their tables, for the owner of the folder to clear.
    """
    held: list[str] = []
    token = _HELD.set(held)
    try:
        yield held
    finally:
        _HELD.reset(token)
        for path in held:
            delete(spark, path)

"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize


def _settled(edges: DataFrame) -> bool:
    """Whether every upper node has one lower one that is nobody's upper node: then edges are stars (or none)."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node for each node of an undirected edge table.

    Returns ``(node, component)`` for every node but the smallest of each component (a node that is not
    listed is its own component's name, or has no edge to another node); self loops and nulls are
    ignored, repeated edges count once, no edges give no rows.  Each round links every node's larger
    neighbours to its smallest one, then every node's smaller neighbours to the smallest, so chains
    shrink geometrically, until nothing but stars is left.  Minima are partial aggregates and are written before they are joined, so both
    sides of each join are plain shuffles that adaptive execution can split at a hub node.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"), (F.col(src) != F.col(dst)).alias("ok"))
    e = materialize(e.where("ok").select("u", "v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = materialize(both.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        kept = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(kept.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

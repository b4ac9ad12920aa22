"""Mixing sources to target weights by hash thresholds found in nested histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import word_count
from cellgrid.operators import ranged
from cellgrid.plans.shared import materialize

# Fixed values of the production mix: weights in the order of source names, share of all sizes, most copies.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEVELS, LEVEL_BITS = 3, 12


def _hash(row_id: Column, text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(row_id, text), 64 - LEVELS * LEVEL_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, h)``: words of the text, and a hash of id and text of LEVELS * LEVEL_BITS bits."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), _hash(F.col(id_col), text).alias("h"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` of a table ``(source, source_size)`` with one row per source.

    Sources by code point, null last, take the weights in turn.  They divide ``share`` of all sizes by
    weight; a target stops at ``most`` times its source's size and the excess is shared again by weight
    until none is above.  One row of sums reaches the driver in each round.
    """
    order = [F.col("source").isNull(), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_i", F.lit(len(weights))) + 1).cast("int"))
    named = materialize(ranged.indexed(sizes, order).select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * float(most)
    total = (named.agg(F.sum("source_size")).first()[0] or 0) * share
    full, rate = F.lit(False), 0.0
    while True:
        stopped, left = named.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not left:
            break
        new = (total - stopped) / left
        if new <= rate:
            break
        rate = new
        full = F.col("weight") * F.lit(rate) >= cap
    return named.select("source", "source_size", F.when(full, cap).otherwise(F.col("weight") * F.lit(rate)).alias("target"))


def plan_mix(base: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: ``copies`` that every document gets, and ``below``: hashes under it get one more.

    The first histogram sums sizes by source and the first bits of the hash; the bucket where a source's
    budget ends is refined by the next bits, and so on.  The last boundary bucket goes in if that brings
    the sum nearer to the budget.
    """
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.least(F.floor(ratio + 1e-12), F.lit(most)).cast("int")
    state = targets(sizes, weights, share, most).withColumn("copies", copies)
    state = state.withColumn("budget", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    state = materialize(state.withColumns({"at": F.lit(0).cast("long"), "open": F.col("budget") > 0}), "mix-targets")
    bits = LEVELS * LEVEL_BITS
    for level in range(1, LEVELS + 1):
        shift = bits - level * LEVEL_BITS
        # all rows of an open source at first, then those of its boundary bucket only
        inside = F.shiftright("h", shift + LEVEL_BITS) == F.col("at")
        open_at = state.where("open").select(F.col("source").alias("s"), "at")
        rows = base.join(open_at, F.col("source").eqNullSafe(F.col("s"))).where(inside)
        hist = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("held"))
        upto = F.sum("held").over(Window.partitionBy("source").orderBy("bucket"))
        cut = hist.withColumn("upto", upto).alias("b").join(state.select(F.col("source").alias("s"), F.col("budget").alias("left")), F.col("b.source").eqNullSafe(F.col("s")))
        edge = cut.where("upto >= left").groupBy("s").agg(F.min(F.struct("bucket", "held", "upto")).alias("edge"))
        joined = state.join(edge, state["source"].eqNullSafe(edge["s"]), "left")
        found = F.col("open") & F.col("edge").isNotNull()
        before = F.col("budget") - (F.col("edge.upto") - F.col("edge.held"))
        # a source whose sums stay under its budget by rounding takes all of its last bucket
        state = materialize(
            joined.select(
                "source", "source_size", "target", "copies",
                F.when(found, before).otherwise(F.col("budget")).alias("budget"),
                F.when(found, F.col("edge.bucket")).when(F.col("open"), F.shiftleft(F.col("at") + 1, LEVEL_BITS)).otherwise(F.shiftleft("at", LEVEL_BITS)).alias("at"),
                found.alias("open"),
                F.when(found, F.col("edge.held")).otherwise(0).alias("held"),
            ),
            "mix-level",
        )
    below = F.col("at") + F.when(F.col("open") & (F.col("budget") * 2 > F.col("held")), 1).otherwise(0)
    return state.select("source", "source_size", "target", "copies", below.alias("below"))


def apply_mix(rows: DataFrame, plan: DataFrame, source_col: str = "source", hash_col: str = "h") -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``times``: how often the mix takes the row."""
    told = plan.select(F.col(source_col).alias("_s"), "source_size", "target", "copies", "below")
    both = rows.join(told, F.col(source_col).eqNullSafe(F.col("_s")))
    times = F.col("copies") + (F.col(hash_col) < F.col("below")).cast("int")
    return both.withColumn("times", times).drop("_s", "copies", "below")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row ``(doc_id, size, source_size, target, times)`` per input row.

    Null text has size 0; null sources form one source, the last; null ids are hashed with their text.
    Which documents a source repeats depends on a hash of id and text only, so reruns agree; rows repeated
    with equal id and text are taken together.  A source without words has target 0.  An empty table gives
    no rows; other columns are ignored.
    """
    base = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    return apply_mix(base, plan_mix(base, weights, share, most)).select("doc_id", "size", "source_size", "target", "times")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The input's rows and columns, each as often as the mix takes it (perhaps never)."""
    base = materialize(sized(docs, id_col, text_col, source_col), "sizes")
    plan = plan_mix(base, weights, share, most)
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.{source_col}").alias("source"), _hash(F.col(f"row.{id_col}"), F.col(f"row.{text_col}")).alias("h"))
    taken = apply_mix(rows, plan).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")

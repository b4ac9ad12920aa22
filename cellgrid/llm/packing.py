"""Best-fit packing: minimum bin slack over the histogram of piece lengths.

Only lengths matter to a packing, and there are at most ``capacity`` of them.  Their histogram is planned
on the driver: for each bin, a bitset of reachable sums over the lengths still available finds the fullest
feasible combination, which is used as often as the counts allow and removed.  Pieces then find their bin
by their rank within their length, which groups count in parallel; a common length has many of these.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.tokens import token_ids, vocabulary
from cellgrid.plans.shared import materialize

CAPACITY = 1024
END_ID = 2
ROWS_PER_SALT = 500


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones of ``capacity`` at the end, the rest first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(text: Column, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> Column:
    """Array of ``(piece, start, length, ids_crc32, ids)`` of a text's ids followed by ``end_id``; ids only if asked for."""

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long,ids:array<int>>>")
    def of(texts: pd.Series) -> pd.Series:
        path, out = vocabulary(tokenizer), []
        for t in texts:
            ids = np.append(token_ids(t, path), np.uint32(end_id)).astype("<u4")
            out.append([(i, a, n, zlib.crc32(ids[a : a + n].tobytes()), ids[a : a + n].astype(np.int32).tolist() if with_ids else None) for i, (a, n) in enumerate(cut_points(len(ids), capacity))])
        return pd.Series(out)

    return of(text)


def fullest(counts: dict[int, int], capacity: int) -> list[int]:
    """Lengths of the fullest bin that holds the longest length of ``counts``, each used at most as often as counted."""
    first = max(counts)
    goal, used = capacity - first, [first]
    sums, steps = 1, []
    limit = (1 << goal + 1) - 1
    for length in sorted((x for x in counts if x <= goal), reverse=True):
        most, times = min(counts[length] - (length == first), goal // length), 1
        while most > 0 and not sums >> goal & 1:
            take = min(times, most)
            grown = (sums | sums << take * length) & limit
            if grown != sums:
                steps.append((sums, length, take))
                sums = grown
            most, times = most - take, times * 2
        if sums >> goal & 1:
            break
    at = sums.bit_length() - 1
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used += [length] * take
            at -= take * length
    return used


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Rows ``(length, rank, until, uses, slot, sequence)``: pieces of a length with ranks from ``rank`` to
    before ``until`` go ``uses`` to a bin, the first at ``slot``, from bin ``sequence`` on.

    Every combination uses up at least half of one length's count, so the rows are at most about
    capacity * log2(pieces), however many pieces there are.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        bin_ = fullest(left, capacity)
        need = {x: bin_.count(x) for x in dict.fromkeys(bin_)}
        times = min(left[x] // n for x, n in need.items())
        slot = 0
        for x, n in need.items():
            rows.append((x, used[x], used[x] + times * n, n, slot, sequence))
            slot += x * n
            used[x] += times * n
            left[x] -= times * n
            if not left[x]:
                del left[x]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "until", "uses", "slot", "sequence"]).sort_values(["length", "rank"], ignore_index=True)


def place(length: Column, rank: Column, plan: pd.DataFrame) -> Column:
    """Struct of ``sequence_id`` and ``offset`` of the piece with this rank among those of its length."""
    table = {k: plan[k].to_numpy(np.int64) for k in plan.columns}
    starts = np.searchsorted(table["length"], np.arange(int(table["length"].max(initial=0)) + 2))

    @F.pandas_udf("sequence_id long, offset long")
    def of(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
        row = np.empty(len(n), np.int64)
        for x in np.unique(n):
            lo, hi = starts[x], starts[x + 1]
            row[n == x] = lo + np.searchsorted(table["rank"][lo:hi], r[n == x], side="right") - 1
        nth, uses = r - table["rank"][row], table["uses"][row]
        return pd.DataFrame({"sequence_id": table["sequence"][row] + nth // uses, "offset": table["slot"][row] + nth % uses * n})

    return of(length, rank)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row ``(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset)`` per piece.

    A document is the ids of its text (null: none), then ``end_id``; one longer than ``capacity`` is cut
    into whole pieces, of which the first may be shorter.  Pieces fill sequences of at most ``capacity``
    ids without gaps.  ``ids`` is null unless ``with_ids``.  Null and repeated ids and rows are carried and
    packed like any others; an empty table gives no rows; other columns are ignored.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), F.explode(pieces(F.col(text_col), tokenizer, end_id, capacity, with_ids)).alias("p")).select("doc_id", "p.*")
    cut = materialize(cut, "pieces")
    # one row per length, so capacity rows at most: safe to collect and to broadcast at any size
    counted = cut.groupBy("length").agg(F.count("*").alias("n")).collect()
    plan = plan_bins({r["length"]: r["n"] for r in counted}, capacity)
    salts = docs.sparkSession.createDataFrame([(r["length"], -(-r["n"] // ROWS_PER_SALT)) for r in counted], "length long, salts long")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))
    groups = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    offsets = groups.select("length", "salt", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("nth", nth).join(offsets, ["length", "salt"])
    placed = ranked.withColumn("at", place(F.col("length"), F.col("before") + F.col("nth"), plan))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the ids of each sequence in order, from ``pack(..., with_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))

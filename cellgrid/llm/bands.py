"""Pairs of shingle sets by Jaccard similarity: bands of minima, and a prefix-filter join for what bands leave open.

A 64-bit fingerprint tells texts apart that share 8 or 9 in 10 of their shingles.  Bands find such pairs: two
sets of similarity s agree in a band of five minima with probability s^5, so of 24 bands one at least meets
for 99.99% of pairs at 0.8.  Whether a pair is alike is decided by its sets alone.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

BANDS, BAND_ROWS = 24, 5
STEP = np.uint64(0x9E3779B97F4A7C15)
AT_ONCE = 255 * 8


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_MULTIPLIERS = _mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * STEP) | np.uint64(1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed 64-bit key per band of a set's hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for lo in range(0, len(hashes), AT_ONCE):
        part = hashes[lo : lo + AT_ONCE]
        low = np.minimum(low, ((part ^ (part >> np.uint64(31)))[None, :] * _MULTIPLIERS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        keys = _mixed(keys * STEP + column)
    return keys.view(np.int64)


def unique_hashes(parts: Iterable[np.ndarray]) -> np.ndarray:
    found = list(parts)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def band_members(bands: DataFrame) -> DataFrame:
    """Rows ``(key, node, n, leader)`` of the nodes that share a band key: ``n`` nodes have it.

    ``bands`` are ``(node, key)``, each once.  A band's leader is the node whose bands are the most shared (of
    these the largest): the text a group was copied from rather than one of its edited copies.
    """
    shared = materialize(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    held = materialize(bands.join(shared, "key"), "held-bands")
    score = materialize(held.groupBy("node").agg(F.sum("n").alias("score")), "band-scores")
    first = materialize(held.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("top")), "band-leaders")
    return materialize(held.join(first, "key").select("key", "node", "n", F.col("top.node").alias("leader")), "band-members")


def open_members(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """``(node, root)`` of the nodes with a band where members beside the leader have different roots.

    ``rooted`` are ``(node, root)`` of the nodes that are linked so far; any other is its own root.  The leader
    has met all others, and texts of one root are one group already, so no other band can add to the groups.
    """
    others = members.where("n > 2 and node != leader").select("key", "node")
    others = materialize(others.join(rooted, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "followers")
    split = materialize(others.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"), "split-bands")
    return others.join(split, "key").select("node", "root").distinct()


def prefix_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(src, dst)`` of ``nodes`` ``(node, root, set)`` of different roots, among them all of this Jaccard similarity or more.

    Sets x and y, x the smaller, of similarity s share s / (1 + s) * (|x| + |y|) elements or more.  So in any
    one order of elements, here the rarest first, their first common one is among the first
    |x| - 2s / (1 + s) * |x| + 1 of x and the first |y| - s * |y| + 1 of y, and what follows it suffices in
    both: joining on these loses no pair.  Of an element that most often has one root only the other rows
    meet all, so members of one large group don't meet each other.
    """
    own = nodes.select("node", "root", F.size("set").alias("n"), F.explode("set").alias("token"))
    often = materialize(own.groupBy("token").agg(F.count("*").alias("often")), "tokens")
    order = F.array_sort(F.collect_list(F.struct("often", "token")))
    ranked = own.join(often, "token").groupBy("node", "root", "n").agg(order.alias("order"))
    up_to = lambda share: (F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-6) + 1).cast("int")
    ranked = ranked.select("node", "root", "n", F.posexplode(F.slice("order", F.lit(1), up_to(similarity))).alias("k", "e"))
    ranked = ranked.where("e.often > 1").select(F.col("e.token").alias("token"), "node", "root", "n", (F.col("n") - F.col("k")).alias("rest"), (F.col("k") < up_to(2 * similarity / (1 + similarity))).alias("short"))
    ranked = materialize(ranked, "prefixes")
    by_root = materialize(ranked.groupBy("token", "root").agg(F.count("*").alias("c")), "token-roots")
    most = materialize(by_root.groupBy("token").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("token", F.col("top.root").alias("main")), "main-roots")
    held = materialize(ranked.join(most, "token").withColumn("main", F.col("root") == F.col("main")), "met-prefixes")

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        fit = F.least("a.rest", "b.rest") >= F.lit(similarity / (1 + similarity)) * (F.col("a.n") + F.col("b.n")) - 1e-6
        sizes = (F.col("a.n") <= F.col("b.n")) & (F.col("a.n") >= F.lit(similarity) * F.col("b.n") - 1e-6)
        on = (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root"))
        return a.alias("a").join(b.alias("b"), on & sizes & fit).select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst"))

    return meet(held.where("short and not main"), held).unionAll(meet(held.where("short and main"), held.where("not main"))).distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` ``(src, dst)`` whose ``sets`` ``(node, set)``, one row a node, have this Jaccard similarity or more."""
    a = sets.select(F.col("node").alias("src"), F.col("set").alias("a"))
    b = sets.select(F.col("node").alias("dst"), F.col("set").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    close = both >= F.lit(similarity) * (F.size("a") + F.size("b") - both)
    return pairs.join(a, "src").join(b, "dst").where(close).select("src", "dst")

"""Palettes: colours reduced by median cut, and looked up again."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

# How much each channel counts for brightness.
CHANNELS = {"r": 0.299, "g": 0.587, "b": 0.114}


class _Box:
    """Counts of one box's pixels by channel and level."""

    def __init__(self, levels: dict[str, dict[int, int]]):
        self.levels = levels
        self.n = sum(levels["r"].values())
        spread = {c: w * (max(levels[c]) - min(levels[c])) for c, w in CHANNELS.items()}
        self.channel = max(spread, key=spread.get)
        self.splits = spread[self.channel] > 0

    def threshold(self) -> int:
        """The level up to which half the pixels lie, below the highest."""
        seen, at = 0, sorted(self.levels[self.channel])
        for level in at[:-1]:
            seen += self.levels[self.channel][level]
            if 2 * seen >= self.n:
                return level
        return at[-2]

    def mean(self) -> list[int]:
        return [(2 * sum(k * n for k, n in self.levels[c].items()) + self.n) // (2 * self.n) for c in CHANNELS]


def _boxes(held: DataFrame, nodes: list[int]) -> dict[int, _Box]:
    """Counts of these boxes: at most 768 numbers each reach the driver."""
    level = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("k")) for c in CHANNELS])).alias("x")
    counts = held.where(F.col("_node").isin(nodes)).select("_node", "_n", level).groupBy("_node", "x.c", "x.k").agg(F.sum("_n").alias("n"))
    found: dict[int, dict[str, dict[int, int]]] = {}
    for node, c, k, n in counts.collect():
        found.setdefault(node, {c: {} for c in CHANNELS})[c][k] = n
    return {node: _Box(levels) for node, levels in found.items()}


def _leaves(known: dict[int, _Box], colours: int) -> tuple[list[int], list[int]]:
    """Boxes in which the fullest one is split until there are enough, and those whose halves are not counted yet."""
    heap, leaves, open_nodes = [(-known[1].n, 1)], 1, []
    done = []
    while heap:
        node = heapq.heappop(heap)[1]
        if not known[node].splits or leaves == colours:
            done.append(node)
            continue
        leaves += 1
        if 2 * node in known:
            for half in (2 * node, 2 * node + 1):
                heapq.heappush(heap, (-known[half].n, half))
        else:
            open_nodes.append(node)
    return done, open_nodes


def cquant(img: DataFrame, colours: int = 256) -> tuple[DataFrame, DataFrame]:
    """The image with a column ``colour``, and the palette ``(colour, r, g, b)`` of at most so many colours.

    ``r``, ``g`` and ``b`` are levels from 0 to 255; one beyond is an error, a pixel without all three has no colour.
    Distinct colours are counted once.  The fullest box of them is split at the median of the channel whose spread is
    the brightest, until there are enough (of equally full ones that of fewer cuts, then the lower half); a box's mean is a
    colour, and each pixel takes the nearest one (ties: the first).  A job counts the halves of all boxes that may be split, so
    there are as many jobs as the cuts are deep, and only counts by level reach the driver.  An image without pixels has an empty palette.
    """
    if not 1 <= colours <= 256:
        raise ValueError("a palette has 1 to 256 colours")
    spark = img.sparkSession
    whole = F.lit(True)
    for c in CHANNELS:
        whole &= F.col(c).isNotNull()
    level = lambda c: F.when(F.col(c).between(0, 255), F.col(c).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no level of a colour: "), F.col(c).cast("string"))).cast("int"))
    counted = img.where(whole).groupBy(*[level(c).alias(c) for c in CHANNELS]).agg(F.count("*").alias("_n"))
    held = materialize(counted.withColumn("_node", F.lit(1).cast("long")), "colours")
    known = _boxes(held, [1])
    leaves: list[int] = []
    if known:
        leaves, cut = _leaves(known, colours)
        while cut:
            splits = spark.createDataFrame([(n, known[n].channel, known[n].threshold()) for n in cut], "_node long, _c string, _t int")
            value = F.coalesce(*[F.when(F.col("_c") == c, F.col(c)) for c in CHANNELS])
            node = F.when(F.col("_t").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + (value > F.col("_t")).cast("long"))
            # at most as many rows as the palette has colours
            held = materialize(held.join(F.broadcast(splits), "_node", "left").select(*CHANNELS, "_n", node.alias("_node")), "colours")
            known |= _boxes(held, [half for n in cut for half in (2 * n, 2 * n + 1)])
            leaves, cut = _leaves(known, colours)
    palette = sorted({tuple(known[n].mean()) for n in leaves})
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(palette)], "colour int, r int, g int, b int")
    if not palette:
        return img.withColumn("colour", F.lit(None).cast("int")), table
    far = lambda k: sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(CHANNELS, palette[k], strict=True)), F.lit(0))
    nearest = F.array_min(F.array(*[F.struct(far(k).alias("d"), F.lit(k).alias("colour")) for k in range(len(palette))]))["colour"]
    named = materialize(held.select(*[F.col(c).alias(f"_{c}") for c in CHANNELS], nearest.alias("colour")), "palette")
    return img.join(named, [F.col(c) == F.col(f"_{c}") for c in CHANNELS], "left").drop(*[f"_{c}" for c in CHANNELS]), table


def interlrgb(img: DataFrame, palette: DataFrame) -> DataFrame:
    """``r, g, b`` of each cell's ``colour`` by a palette ``(colour, r, g, b)``; null for a colour that it lacks."""
    return img.join(palette.select("colour", *CHANNELS), "colour", "left")

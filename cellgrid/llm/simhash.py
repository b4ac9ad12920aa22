"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Every distinct fingerprint emits each value within half the radius of itself; fingerprints that meet at
a value are within the radius of one another.  A value is met by at most as many distinct fingerprints
as its half-radius ball holds (65 for radius 2), so no group is unbounded, and linking neighbours in
order within it gives the same components as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm import bands
from cellgrid.operators.graph import connected_components
from cellgrid.plans.shared import materialize

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
BLOCK = 1 << 16


def shingle_hashes(text: bytes | None, shingle_words: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in blocks; none for a text without words."""
    words = (text or b"").translate(LOWER).split()  # splits at space and \t..\r only
    n = len(words)
    if not n:
        return
    joined, k = b" ".join(words), min(shingle_words, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, digest = n - k + 1, xxhash.xxh64_intdigest
    for lo in range(0, total, BLOCK):
        hi = min(total, lo + BLOCK)
        spans = zip(starts[lo:hi].tolist(), ends[lo + k - 1 : hi + k - 1].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def simhash64(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint of blocks of shingle hashes as a signed 64-bit integer; 0 without any."""
    set_bits, total = np.zeros(64, np.int64), 0
    for block in hashes:
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(block)
    return int(np.packbits(set_bits * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle_words: int = 5) -> Column:
    """SimHash column of a string column (null: as empty)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(shingle_hashes(t, shingle_words)) for t in texts], dtype="int64")

    return of(text.cast("binary"))


def signature(text: Column, shingle_words: int = 5) -> Column:
    """Struct of a text's fingerprint ``fp`` and its band keys ``keys``, of which the fingerprint itself is one."""

    @F.pandas_udf("fp long, keys array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            blocks = list(shingle_hashes(t, shingle_words))
            fp = simhash64(blocks)
            out.append((fp, np.unique(np.append(bands.band_keys(bands.unique_hashes(blocks)), fp))))
        return pd.DataFrame(out, columns=["fp", "keys"])

    return of(text.cast("binary"))


def shingle_set(text: Column, shingle_words: int = 5) -> Column:
    """The distinct shingles of a text as 32-bit hashes."""

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        found = (bands.unique_hashes(shingle_hashes(t, shingle_words)) for t in texts)
        return pd.Series([np.unique(x.astype(np.uint32)).view(np.int32) for x in found])

    return of(text.cast("binary"))


def ball_masks(radius: int, bits: int = 64) -> list[int]:
    """XOR masks of the ball of half the radius, as signed 64-bit integers."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: half of it is the radius of each ball")
    found = [sum(1 << i for i in c) for d in range(radius // 2 + 1) for c in combinations(range(bits), d)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(src, dst)`` between distinct values of column ``fp`` that join all within ``radius``."""
    masks = F.lit(ball_masks(radius))
    met = distinct.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("meet"))
    before = F.lag("fp").over(Window.partitionBy("meet").orderBy("fp"))
    pairs = met.select("fp", before.alias("other")).where(F.col("other").isNotNull())
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius).select(F.col("fp").alias("src"), F.col("other").alias("dst")).distinct()


def roots(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint; a fingerprint without links is its own root."""
    found = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("to"))
    return distinct.select("fp").join(found, "fp", "left").select("fp", F.coalesce("to", "fp").alias("root"))


def fingerprint_components(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``(fp, root)`` over links of at most ``radius`` differing bits."""
    return roots(distinct, fingerprint_links(distinct, radius))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 2) -> DataFrame:
    """One row ``(doc_id, fp, component_id)`` per input row.

    component_id is the smallest id reachable over links of at most ``radius`` differing bits, itself
    included.  Null text counts as empty; empty texts share fingerprint 0.  A null id is kept and never
    the smallest; a group of null ids only has a null component.  Repeated rows stay repeated.  An empty
    table gives no rows.  Other columns of the input are ignored, whatever their names.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), shingle_words).alias("fp")), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    rooted = materialize(distinct.join(fingerprint_components(distinct, radius), "fp"), "rooted")
    lowest = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text (null: as empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t).alias("b")]


def _same_row(id_col: Column, left: DataFrame, right: DataFrame) -> Column:
    return id_col.eqNullSafe(right["id"]) & (left["a"] == right["a"]) & (left["b"] == right["b"])


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """The input's rows and columns with one row of each near-duplicate group.

    Different texts (by 128 hash bits) are linked if the Jaccard similarity of their shingles is ``similarity``
    or more, whatever their fingerprints.  They meet if their fingerprints differ in at most ``radius`` bits, or
    if they share a band of minima; each meets the text that leads the group, and those of a group that this
    doesn't join meet each other by prefixes of their sets.  Groups are what links connect.  The row with the
    smallest id stays (null ids last); of rows repeated with the same id and text the one whose columns come
    first as JSON.  Texts without words have one fingerprint and equal, empty sets: they are linked.  Null text counts as empty.  An empty table gives no rows.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_text_key(F.col(text_col)), signature(F.col(text_col), shingle_words).alias("s"))
    rows = materialize(keyed.select("doc_id", "a", "b", "s.*"), "signatures")
    # nodes are numbered once, in a written table, so that a repeated task cannot number them anew
    nodes = rows.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.count("*").alias("times"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    members = bands.band_members(nodes.select("node", F.explode("keys").alias("key")))
    # of the fingerprints within the radius of one another a text each; those of one fingerprint share a band
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    links = materialize(fingerprint_links(first, radius), "balls")
    links = links.join(first.select(F.col("fp").alias("src"), F.col("node").alias("x")), "src").join(first.select(F.col("fp").alias("dst"), F.col("node").alias("y")), "dst").select(F.col("x").alias("src"), F.col("y").alias("dst"))
    near = materialize(links.unionAll(members.where("node != leader").select("node", "leader")).distinct(), "near")
    # the shingles of every text in a pair: texts move once here and once at the end, by the same plan at every size
    asked = near.select(F.col("src").alias("node")).unionAll(near.select("dst")).distinct().join(nodes, "node").select("node", "id", "a", "b")
    asked = materialize(asked, "asked")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_text_key(F.col(text_col)), F.col(text_col).alias("text"))
    sets = texts.join(asked.hint("merge"), _same_row(texts["doc_id"], texts, asked)).select("node", shingle_set(F.col("text"), shingle_words).alias("set"))
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    alike = materialize(bands.similar(near, sets, similarity), "alike")
    led = connected_components(alike).select("node", F.col("component").alias("root"))
    left = bands.open_members(members, led).join(sets, "node")
    more = materialize(bands.prefix_pairs(materialize(left, "open"), similarity), "open-pairs")
    found = connected_components(led.select(F.col("node").alias("src"), F.col("root").alias("dst")).unionAll(bands.similar(more, sets, similarity)))
    rooted = materialize(nodes.join(found, "node", "left").select("a", "b", "id", "times", F.coalesce("component", "node").alias("root")), "rooted")
    # the text with the smallest id, null ids last, then the smallest hashes
    low = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "a", "b")).alias("low")).select("low.*")
    held = rows.groupBy("doc_id", "a", "b").agg(F.count("*").alias("times"))
    keys = materialize(low.join(held, _same_row(held["doc_id"], held, low)).select(low["id"], low["a"], low["b"], "times"), "kept")
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_text_key(F.col(text_col)), F.struct("*").alias("row"))
    once, again = keys.where("times = 1").hint("merge"), keys.where("times > 1")
    repeated = whole.join(again, _same_row(whole["doc_id"], whole, again)).groupBy("id", whole["a"], whole["b"]).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return whole.join(once, _same_row(whole["doc_id"], whole, once)).select("row.*").unionAll(repeated.select("row.*"))

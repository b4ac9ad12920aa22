"""Quality rules: word statistics, and compression bands fitted to the corpus by length.

How well prose compresses depends on its length, so the band of zstandard ratios that a text must lie in is
found for each half-octave of length from all texts that pass the word rules: its middle half, widened.
Texts beyond it repeat themselves (or are full of markers), or are noise.  Chunks are judged alike.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

# Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
# Bytes from which the outermost limits of the ratio of plain to compressed size hold, whatever the corpus.
LIMITS = ((0, 1.2, 5.0), (512, 1.3, 5.0), (1024, 1.4, 6.0), (4096, 1.4, 8.0), (65536, 1.4, 10.0))
# A band reaches beyond the quartiles by so many times their distance, and by this share of the median at least:
# a part for all lengths, and one that falls with the root of the bytes as chance evens out.
REACH, SPREAD, CHANCE = 2.0, 0.06, 2.0
# Texts that stand for no knowledge of a length, spread evenly over its limits.  A length is judged with those
# beside it, up to NEAR half-octaves away, and further ones if they have fewer than ENOUGH texts.
PRIOR, NEAR, ENOUGH = 4, 1, 50
CHUNK_BYTES, LEAST_CHUNK = 4096, 1024
MAX_BAD_CHUNKS = 0.25
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
LEVEL = 3
MOST_RATIO = 100
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_bytes long, packed long, chunks array<struct<n_bytes:long,packed:long>>"


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a run of ``width`` words found twice or more among ``words``."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)
    runs = ids
    for i in range(1, width):
        _, dense = np.unique(runs[:-1] * n + ids[i:], return_inverse=True)
        runs = dense
    again = np.bincount(runs)[runs] > 1
    steps = np.zeros(n + 1, np.int64)
    steps[: len(runs)] += again
    steps[width : width + len(runs)] -= again
    return int((np.cumsum(steps[:-1]) > 0).sum())


def judge(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    """FIELDS of one text; ``chunks`` are its whole chunks, and what is left if that is long enough."""
    data = (text or "").encode()
    words = data.split()  # at space and \t..\r only
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated, n = repeated_words(words), len(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
    packed = len(packer.compress(data))
    chunks = [(len(data), packed)] if len(data) <= CHUNK_BYTES else [(len(c), len(packer.compress(c))) for at in range(0, len(data), CHUNK_BYTES) if len(c := data[at : at + CHUNK_BYTES]) >= LEAST_CHUNK]
    return n, len(b"".join(words).decode()), sum(map(data.count, (bytes([c]) for c in SYMBOLS))), len(lines) - len(set(lines)), repeated, failed, len(data), packed, chunks


def measure(text: Column) -> Column:
    """Struct of FIELDS for a string column; null counts as empty."""

    @F.pandas_udf(FIELDS)
    def of(texts: pd.Series) -> pd.DataFrame:
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        return pd.DataFrame([judge(t, packer) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bytes", "packed", "chunks"])

    return of(text)


def _key(text: Column) -> Column:
    """What tells texts apart; a null one is as an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("key")


def _length_bin(n_bytes: Column) -> Column:
    return F.floor(2 * F.log2(n_bytes.cast("double"))).cast("int")


def band(length_bin: int, ratios: dict[int, int]) -> tuple[float, float]:
    """Least and greatest ratio for a half-octave of length, from counts of hundredths of ratios."""
    size = 2 ** (length_bin / 2)
    low, high = max(x for x in LIMITS if x[0] <= size)[1:]
    spread = [low + (high - low) * (i + 0.5) / PRIOR for i in range(PRIOR)]
    seen = sorted([((k + 0.5) / 100, n) for k, n in ratios.items()] + [(x, 1) for x in spread])
    upto = np.cumsum([n for _, n in seen])
    first, middle, third = (seen[int(np.searchsorted(upto, upto[-1] * q))][0] for q in (0.25, 0.5, 0.75))
    reach = max(REACH * (third - first), middle * (SPREAD + CHANCE / math.sqrt(size)))
    return max(low, first - reach), min(high, third + reach)


def with_neighbours(bins: dict[int, dict[int, int]], at: int) -> dict[int, int]:
    """A length's counts with those NEAR it, and of ever further lengths until they are ENOUGH or all."""
    held: dict[int, int] = {}
    for far in range(max((abs(b - at) for b in bins), default=0) + 1):
        for b in {at - far, at + far}:
            for ratio, n in bins.get(b, {}).items():
                held[ratio] = held.get(ratio, 0) + n
        if far >= NEAR and sum(held.values()) >= ENOUGH:
            break
    return held


def fit_bands(measured: DataFrame) -> dict[str, dict[int, tuple[float, float]]]:
    """Bands by length bin, for whole texts and for chunks, of a table with ``key``, a hash of the text, and FIELDS.

    All texts that pass the word rules count, and all their chunks; copies of a text count once, so that a hot
    one does not make the band.  Counts of hundredths of the ratio reach the driver: at most 130 bins times
    100 * MOST_RATIO of them.
    """
    once = measured.groupBy("key").agg(F.first(F.struct("base_failed", "n_bytes", "packed", "chunks")).alias("m"))
    sized = lambda kind, n, packed: F.struct(F.lit(kind).alias("kind"), n.alias("n_bytes"), packed.alias("packed"))
    sizes = F.concat(F.array(sized("whole", F.col("m.n_bytes"), F.col("m.packed"))), F.transform("m.chunks", lambda c: sized("chunk", c["n_bytes"], c["packed"])))
    kinds = once.where("not m.base_failed").select(F.explode(F.filter(sizes, lambda x: x["n_bytes"] > 0)).alias("x")).select("x.*")
    hundredths = F.least(F.floor(100 * F.col("n_bytes") / F.col("packed")), F.lit(100 * MOST_RATIO)).cast("int")
    counts = kinds.groupBy("kind", _length_bin(F.col("n_bytes")).alias("bin"), hundredths.alias("ratio")).agg(F.count("*").alias("n"))
    held: dict[str, dict[int, dict[int, int]]] = {"whole": {}, "chunk": {}}
    for kind, length_bin, ratio, n in counts.collect():
        held[kind].setdefault(length_bin, {})[ratio] = n
    return {kind: {b: band(b, with_neighbours(bins, b)) for b in bins} for kind, bins in held.items()}


def _inside(n_bytes: Column, packed: Column, bands: dict[int, tuple[float, float]]) -> Column:
    """Whether a size lies in the band of its length; false for an empty text."""
    if not bands:
        return F.lit(False)
    table = F.create_map(*[F.lit(x) for b, (low, high) in bands.items() for x in (b, F.array(F.lit(low), F.lit(high)))])
    at = F.try_element_at(table, _length_bin(n_bytes))
    return F.coalesce((n_bytes / packed).between(F.get(at, F.lit(0)), F.get(at, F.lit(1))), F.lit(False))


def verdict(m: Column, bands: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """kept: a measured text that passes the word rules, whose ratio lies in its band, and of whose chunks at most MAX_BAD_CHUNKS don't."""
    bad = F.size(F.filter(m["chunks"], lambda c: ~_inside(c["n_bytes"], c["packed"], bands["chunk"])))
    return ~m["base_failed"] & _inside(m["n_bytes"], m["packed"], bands["whole"]) & (bad <= MAX_BAD_CHUNKS * F.size(m["chunks"]))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``doc_id``, FIELDS, ``n_bad_chunks`` and ``kept`` per input row; texts are not shuffled.

    kept is false for texts under 50 words, with over half of their words in repeated three-word runs,
    whose zstandard ratio is outside the band of their length, or of which over a quarter of the 4 KB
    chunks are outside the band of theirs (a text of up to 4 KB is one chunk; what a longer one has left
    over is one from 1 KB on).  Null counts as empty: no words, not kept.  Null ids and repeated rows stay,
    an empty table gives no rows, other columns are ignored.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), _key(F.col(text_col)), measure(F.col(text_col)).alias("m"))
    measured = materialize(measured.select("doc_id", "key", "m.*"), "measures")
    bands = fit_bands(measured)
    m = F.struct(*measured.columns[2:])
    bad = F.size(F.filter("chunks", lambda c: ~_inside(c["n_bytes"], c["packed"], bands["chunk"])))
    return measured.drop("key").select("*", bad.cast("long").alias("n_bad_chunks"), verdict(m, bands).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input's rows, with its columns whatever their names, that ``scores`` keeps.

    Texts are measured twice, first for the bands and then for the verdict, rather than shuffled.
    """
    bands = fit_bands(docs.select(_key(F.col(text_col)), measure(F.col(text_col)).alias("m")).select("key", "m.*"))
    rows = docs.select(F.struct("*").alias("row")).withColumn("m", measure(F.col(f"row.{text_col}")))
    return rows.where(verdict(F.col("m"), bands)).select("row.*")

"""Exact substring removal: repeated windows of words, by Rabin-Karp hashes counted in Spark.

Equal windows hold the same smallest hash of a shorter run of words (their anchor), so only windows
whose anchor occurs at two or more places can be repeated.  Anchors are counted first; windows are then
hashed, counted and joined back only where their anchor repeats.  This finds exactly the repeated
windows and shuffles a small part of what shuffling every window would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import column
from cellgrid.plans.shared import materialize

# Two odd multipliers of the polynomial hashes, any fixed odd values do.
BASE = 0x9E3779B97F4A7C15
BASE_2 = 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
SEED_2 = 1
ANCHOR_WORDS = 8
DOCS_AT_ONCE = 256


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


def rolling(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2^64 of every ``length`` consecutive word hashes."""
    n = len(words)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    mixed = (sums[length:] - sums[:-length]) * down[: n - length + 1]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(BASE_2)
    return mixed ^ (mixed >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return pick(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def word_hashes(text: bytes | None, seed: int = 0) -> np.ndarray:
    words = (text or b"").split()
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def window_minima(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``anchor`` words, and the smallest in each window."""
    grams = rolling(words, anchor, BASE)
    return grams, _sliding(grams, window - anchor + 1, np.minimum)


def anchors(text: bytes | None, window: int, anchor: int) -> np.ndarray:
    """The anchor hash at each place that is the smallest of some window; a hash found at two places twice."""
    words = word_hashes(text)
    if len(words) < window:
        return np.zeros(0, np.int64)
    grams, low = window_minima(words, window, anchor)
    reach = window - anchor
    ends = np.zeros(reach, np.uint64)
    best = _sliding(np.concatenate([ends, low, ends]), reach + 1, np.maximum)
    return grams[best == grams].view(np.int64)


def _text_key(text: Column) -> Column:
    """Two 64-bit hashes; equal for equal texts (null: as empty)."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(SEED_2), t).alias("b"))


def _packed(text: Column) -> Column:
    """UTF-8 of a text (null: empty) under zstandard, as half the size is shuffled then."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        packer = zstandard.ZstdCompressor(level=3)
        return pd.Series([packer.compress(t or b"") for t in texts])

    return of(text.cast("binary"))


def repeated_starts(docs: DataFrame, text_col: str = "text", window: int = 35, anchor: int = ANCHOR_WORDS) -> tuple[DataFrame, DataFrame]:
    """What repeats: ``(key, starts)`` of texts given once, and ``key`` of texts given twice or more.

    key is a struct of two hashes of the whole text; starts are the word positions where a window begins
    whose words also begin elsewhere.
    """
    anchor = min(anchor, window)

    @F.pandas_udf("array<long>")
    def anchors_of(texts: pd.Series) -> pd.Series:
        return pd.Series([anchors(t, window, anchor) for t in texts])

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = zstandard.ZstdDecompressor()
        for b in batches:
            for lo in range(0, len(b), DOCS_AT_ONCE):  # so that what is held does not grow with Arrow's batches
                part = b.iloc[lo : lo + DOCS_AT_ONCE]
                found = []
                for t, want in zip(part["text"], part["wanted"], strict=True):
                    words = word_hashes(opener.decompress(t))
                    _, low = window_minima(words, window, anchor)
                    at = np.flatnonzero(np.isin(low.view(np.int64), np.asarray(want, np.int64)))
                    second = (rolling(words * np.uint64(BASE_2), window, BASE_2)[at] >> np.uint64(32)).astype(np.uint32)
                    found.append((rolling(words, window, BASE)[at].view(np.int64), second.view(np.int32), at.astype(np.int32)))
                h, g, start = (np.concatenate(x) for x in zip(*found, strict=True))
                times = [len(x[0]) for x in found]
                yield pd.DataFrame({**{c: np.repeat(part[c].to_numpy(), times) for c in ("a", "b", "times")}, "h": h, "g": g, "start": start})

    text = F.col(text_col)
    found = materialize(docs.select(_text_key(text).alias("key"), anchors_of(text.cast("binary")).alias("anchors")), "anchors")
    texts = materialize(found.groupBy("key").agg(F.count("*").alias("times")), "texts")
    one = found.select("key", F.explode("anchors").alias("anchor"))
    twice = one.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    wanted = one.join(materialize(twice, "repeated"), "anchor").groupBy("key").agg(F.collect_set("anchor").alias("wanted"))
    wanted = materialize(wanted.join(texts, "key"), "wanted")
    # of a text given many times every row that reaches here says the same: weight 2 stands for "also elsewhere"
    keyed = docs.select(_text_key(text).alias("key"), _packed(text).alias("text"))
    chosen = keyed.join(wanted, "key").select("key.a", "key.b", "times", "text", "wanted")
    met = chosen.mapInPandas(windows_of, "a long, b long, times long, h long, g int, start int")
    # written, so that both sides of the join below are plain shuffles, which can be split at a common window
    counted = materialize(met.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").select("h", "g"), "windows")
    again = met.where("times = 1").join(counted, ["h", "g"]).groupBy("a", "b").agg(F.collect_list("start").alias("starts"))
    again = again.select(F.struct("a", "b").alias("key"), "starts")
    return again, texts.where("times > 1").select("key")


def _kept(text: bytes | None, starts: np.ndarray | None, whole: bool, window: int) -> tuple[list[bytes], np.ndarray]:
    """The words of a text, and a mask of those that stay."""
    words = (text or b"").split()
    n = len(words)
    steps = np.zeros(n + 1, np.int64)
    if whole and n >= window:
        steps[0], steps[n] = 1, -1
    elif starts is not None and len(starts):
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + window, -1)
    return words, np.cumsum(steps[:-1]) == 0


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = 35, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """``row``, a struct of the input's other columns, with ``n_words``, ``n_removed``, ``kept_text`` and ``spans``.

    Each word goes that a repeated window covers; spans are the maximal intervals ``[from, to)`` of
    removed word positions.  Windows are judged on the input.  Null text has no words and an empty kept
    text; a text shorter than the window loses nothing; repeated rows repeat all their windows; an empty
    table gives no rows.  Ids are not used, so null or repeated ids do no harm.
    """

    @F.pandas_udf("n_words long, n_removed long, kept_text string, spans array<array<long>>")
    def cut(texts: pd.Series, starts: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out, opener = [], zstandard.ZstdDecompressor()
        for t, s, all_of_it in zip(texts, starts, whole, strict=True):
            words, keep = _kept(opener.decompress(t), None if s is None else np.asarray(s, np.int64), bool(all_of_it), window)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ~keep, [0]]).astype(np.int8)))
            text = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode("utf-8", "replace")
            out.append((len(words), int((~keep).sum()), text, edge.reshape(-1, 2).tolist()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "spans"])

    again, copies = repeated_starts(docs, text_col, window, anchor)
    marks = again.select("key", "starts", F.lit(False).alias("whole")).unionAll(copies.select("key", F.lit(None).cast("array<int>"), F.lit(True)))
    others = [column(c) for c in docs.columns if c != text_col]
    row = F.struct(*others) if others else F.lit(None).cast("struct<none:int>")
    rows = docs.select(_text_key(F.col(text_col)).alias("key"), row.alias("row"), _packed(F.col(text_col)).alias("packed"))
    both = rows.join(marks, "key", "left")
    return both.select("row", cut("packed", "starts", F.coalesce("whole", F.lit(False))).alias("cut")).select("row", "cut.*")

"""Spelling variants: words of one corpus that differ by one edit, grouped under their commonest form.

Two words within one edit share one of their three rarest bigrams (an edit spoils two at most), as near to
the start, or to the end, in both.  On one side of that bigram they are then equal, and on the other so is
the first or the second half.  Words meet on just that, so a common bigram brings no crowd together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
# Bigrams that an edit can spoil, and one more.
RAREST = 3
# Distinct words that a task counts before it hands them on.
HELD = 1 << 18


def runs_of(doc_id: str, text: str | None, min_length: int = MIN_LENGTH, typo_every: int | None = None) -> Iterator[tuple[str, int]]:
    """A text's lower-cased words of ``min_length`` code points, with how often they are there.

    With ``typo_every`` a word loses one of its code points if that number divides the CRC-32 of ``<doc_id>:<word>``.
    """
    start = zlib.crc32(f"{doc_id}:".encode())
    for word, n in Counter(RUN.findall((text or "").encode().translate(LOWER).decode())).items():
        if len(word) < min_length:
            continue
        if typo_every:
            h = zlib.crc32(word.encode(), start)
            if h % typo_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < min_length:
                    continue
        yield word, n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """``(word, n)`` of runs of Latin letters with A-Z lower-cased, that occur ``min_count`` times or more in all.

    Tasks count before they shuffle, and hold HELD distinct words at most.  A null text has no words, a null
    id stands as an empty one; repeated rows count again; an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": list(held.keys()), "n": list(held.values())})

        for b in batches:
            for doc, text in zip(b["id"], b["text"], strict=True):
                for word, n in runs_of(doc, text, min_length, typo_every):
                    held[word] += n
                if len(held) >= HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Each bigram's place from the rarest on, by how many bigrams of distinct words it is, ties by the bigram.

    The driver gets one row per bigram, so at most the square of the alphabet: 8,100 for the words of ``word_counts``.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for b in batches:
            for word in b["word"]:
                held.update(map("".join, zip(word, word[1:], strict=False)))
        if held:
            yield pd.DataFrame({"gram": list(held.keys()), "n": list(held.values())})

    counted = words.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counted, key=lambda r: (r["n"], r["gram"])))}


def meeting_keys(word: str, order: dict[str, int]) -> tuple[list[int], list[int]]:
    """Hashes under which a word meets others of its length or longer by one, which it looks up as the shorter (second list).

    For each of the RAREST bigrams: what lies from the start up to its end, or from its start to the end, with
    the first or second half of the rest, halves being those of the longer word's rest.
    """
    first = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))[:RAREST]
    own, shorter = set(), set()
    for _, i in first:
        for side, fixed, rest in (("<", word[: i + 2], word[i + 2 :]), (">", word[i:], word[:i])):
            for keys, m in ((own, len(rest)), (shorter, len(rest) + 1)):
                half = m // 2
                for part, same in ((0, rest[:half]), (1, rest[max(0, len(rest) - (m - half)) :])):
                    keys.add(xxhash.xxh64_intdigest(f"{side}{fixed}\t{m}\t{part}\t{same}") - (1 << 63))
    return list(own), list(shorter)


def near_words(words: DataFrame) -> DataFrame:
    """Rows ``(word, n, other, other_n)``, both ways, for words ``(word, n)`` that differ by one edit of a code point."""
    order = bigram_order(words)

    @F.pandas_udf("own array<long>, shorter array<long>")
    def keys(w: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([meeting_keys(x, order) for x in w], columns=["own", "shorter"])

    both = words.where(F.char_length("word") > 1).select("word", "n", keys(F.col("word")).alias("k"))
    tagged = lambda name, short: F.transform(F.col(f"k.{name}"), lambda x: F.struct(x.alias("key"), F.lit(short).alias("short")))
    met = materialize(both.select("word", "n", F.explode(F.concat(tagged("own", False), tagged("shorter", True))).alias("k")).select("k.key", "k.short", "word", "n"), "meeting-keys")
    left = met.where("not short").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    right = met.select("key", "short", F.col("word").alias("b"), F.col("n").alias("bn"))
    length = lambda c: F.char_length(F.col(c))
    alike = (F.col("short") & (length("a") == length("b") + 1)) | (~F.col("short") & (F.col("a") < F.col("b")) & (length("a") == length("b")))
    # one row a pair before the shuffle that makes pairs unique
    pairs = left.join(right, "key").where(alike & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn").distinct()
    pairs = materialize(pairs, "near-words")
    turned = pairs.select(F.col("b").alias("word"), F.col("bn").alias("n"), F.col("a").alias("other"), F.col("an").alias("other_n"))
    return pairs.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("other"), F.col("bn").alias("other_n")).unionAll(turned)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: the end of each word's chain, by doubling of its steps.

    Every form has a multiple of its word's count, so chains have no cycle and few steps.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each of the distinct ``words`` ``(word, n)``.

    A word's form is its commonest near word (ties: the first in code-point order) if that is ``ratio`` times as
    common, else null; the root ends the chain of forms, and is the word itself without one.  An empty table
    gives no rows.
    """
    words = materialize(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = materialize(near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n")), "nearest")
    said = words.join(near, "word", "left").withColumn("_ok", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
    chosen = said.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_ok"), F.col("form")).alias("form"), F.when(F.col("_ok"), F.col("form_n")).alias("form_n"))
    chosen = materialize(chosen, "forms")
    ends = roots(chosen.where("form is not null"))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

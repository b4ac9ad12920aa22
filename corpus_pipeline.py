"""A corpus from documents to packed sequences, in five stages that are each written and read again.

1. quality rules: documents that the word statistics or the compression bands reject go;
2. line dedup: lines on over a tenth of a source's documents go (a source stands for a site), n_chars follows;
3. near-dedup: of documents that share four fifths of their five-word shingles, the one with the smallest id stays;
4. mix: each document is there as often as its source's target takes it, perhaps never;
5. packing: pieces of at most 1024 ids with their sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import line_dedup, mixing, packing, quality, simhash
from cellgrid.llm.common import small_batches, table
from cellgrid.plans.shared import delete, materialize, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.keep_good(docs)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    cut = line_dedup.drop_boilerplate(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    chars = F.when(F.col("n_dropped") > 0, F.char_length("kept_text")).otherwise(F.col("row.n_chars"))
    changed = {"text": text, "n_chars": chars.cast("long")}
    return cut.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", site_lines),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# fingerprints, compression and tokens are beyond SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages wrote on the way is deleted as soon as the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as held:
            docs = materialize(stage(spark, docs, sf_dir), name)
            mine = held.pop()
        if before:
            delete(spark, before)
        before = mine
    return docs

"""Token counts of flat token files by a scan for separators.

A flat file is nothing but ids, each document's followed by a separator.  It is read in blocks; each block
is searched on its own by numpy, and a two-level prefix scan over the blocks' counts and last separators
stitches documents that cross blocks, so a file of any size is counted by as many tasks as it has blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.llm.tokens import token_ids, vocabulary
from cellgrid.plans.shared import materialize

# Fixed value: the vocabulary's end-of-document identifier.
END_OF_DOCUMENT = 50256
# What the same identifier inside a text is written as: outside the vocabulary, so it ends no document.
IN_TEXT = 0xFFFF
BLOCK_BYTES = 256 << 10
BLOCKS_PER_GROUP = 1024


def read_token_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, seek: bool = True) -> DataFrame:
    """Blocks ``(file, block, data)`` of the flat files under a path.

    Spark lists files and lengths without their contents; blocks are then dealt to tasks, and each is read by
    seeking to it, so files may have any length.  Where only Spark's readers reach the store, ``seek=False``
    has each file read whole by one task: files must be under 2 GB there.
    """
    files = spark.read.format("binaryFile").load(path)
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0).cast("long")))).alias("block")
    if not seek:
        blocks = files.select(F.col("path").alias("file"), "content", at)
        return blocks.select("file", "block", F.substring("content", (F.col("block") * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("data"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, block, length in zip(b["file"], b["block"], b["length"], strict=True):
                system, place = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", quote(file, safe=":/")))
                with system.open_input_file(place) as f:
                    data = f.read_at(max(0, min(block_bytes, length - block * block_bytes)), block * block_bytes)
                yield pd.DataFrame({"file": [file], "block": [block], "data": [data]})

    return files.select(F.col("path").alias("file"), "length", at).repartition("file", "block").mapInPandas(read, "file string, block long, data binary")


def tokenize_to_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Flat files of 16-bit ids, one for each task, as blocks ``(file, block, data, ids)``.

    ids are the ids of the documents that end in the block, in order: a label beside the flat data that
    the scan does not use.  An id of ``IN_TEXT`` or more is an error.  Null text has no tokens but a separator.  A text that names the separator in
    full has its identifier as an ordinary one, written as ``IN_TEXT``.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, held, ends, total, block, name = vocabulary(tokenizer), bytearray(), [], 0, 0, ""

        def row(upto: int) -> pd.DataFrame:
            mine = [d for end, d in ends if end <= upto]
            del ends[: len(mine)]
            return pd.DataFrame({"file": [name], "block": [block], "data": [bytes(held[:block_bytes])], "ids": [mine]})

        for b in batches:
            for doc, text, part in zip(b["doc_id"], b["text"], b["part"], strict=True):
                name = f"tokens-{part:06d}"
                found = token_ids(text, path)
                if found.max(initial=0) >= IN_TEXT:
                    raise ValueError(f"{tokenizer} has ids that 16 bits don't hold")
                data = np.append(np.where(found == END_OF_DOCUMENT, IN_TEXT, found), END_OF_DOCUMENT).astype("<u2").tobytes()
                held += data
                total += len(data)
                ends.append((total, None if doc is None else int(doc)))
                while len(held) >= block_bytes:
                    yield row((block + 1) * block_bytes)
                    del held[:block_bytes]
                    block += 1
        if held:
            yield row(total)

    # ids travel as text: in pandas a column of longs with a null among them would be rounded to floats
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    return rows.mapInPandas(write, "file string, block long, data binary, ids array<long>")


def separators(data: Column, eod: int, dtype: str) -> Column:
    """Struct of a block's number of ids and the places of its separators."""

    @F.pandas_udf("n long, at array<int>")
    def of(blocks: pd.Series) -> pd.DataFrame:
        found = [np.frombuffer(b, dtype) for b in blocks]
        return pd.DataFrame({"n": [len(x) for x in found], "at": [np.flatnonzero(x == eod).astype(np.int32) for x in found]})

    return of(data)


def _before(rows: DataFrame, by_group: int) -> DataFrame:
    """Blocks with what lies before each in its file: ``ids_before``, ``ends_before`` and ``last_before``, the
    place in the file of the last separator before (-1: none).  Groups of blocks are summed first."""
    here = rows.withColumn("part", F.floor(F.col("block") / by_group))
    inner = Window.partitionBy("file", "part").orderBy("block")
    prior = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = here.select("*", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("n0"), F.coalesce(F.sum("ends").over(prior), F.lit(0)).alias("e0"))
    last = F.max(F.when(F.col("ends") > 0, F.col("n0") + F.col("last"))).over(prior)
    local = local.withColumn("l0", last)
    groups = local.groupBy("file", "part").agg(F.sum("n").alias("gn"), F.sum("ends").alias("ge"), F.max(F.when(F.col("ends") > 0, F.col("n0") + F.col("last"))).alias("gl"))
    outer = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("*", F.coalesce(F.sum("gn").over(outer), F.lit(0)).alias("g_ids"), F.coalesce(F.sum("ge").over(outer), F.lit(0)).alias("g_ends"))
    groups = groups.withColumn("g_last", F.max(F.col("g_ids") + F.col("gl")).over(outer)).select("file", "part", "g_ids", "g_ends", "g_last")
    both = local.join(groups, ["file", "part"])
    return both.select("file", "block", (F.col("g_ids") + F.col("n0")).alias("ids_before"), (F.col("g_ends") + F.col("e0")).alias("ends_before"), F.coalesce(F.col("g_ids") + F.col("l0"), "g_last", F.lit(-1)).alias("last_before"))


def count_tokens(blocks: DataFrame, eod: int = END_OF_DOCUMENT, dtype: str = "<u2", blocks_per_group: int = BLOCKS_PER_GROUP, open_end: bool = True) -> DataFrame:
    """One row ``(file, nth, start, n_tokens)`` per document: its number in the file, its first id's place, its ids.

    A separator ends a document and is not counted; two in a row give a document of 0 ids.  Ids after the
    last separator are a document too if ``open_end``.  Blocks hold whole ids and are numbered by order in
    ``block``; other columns are ignored; an empty table, or an empty file, gives no rows.  A block that ends
    within an id, as the last one of a truncated file does, is an error that names the file.
    """
    cut = F.raise_error(F.concat(F.col("file"), F.lit(" ends within an id, in block "), F.col("block").cast("string"))).cast("binary")
    whole_ids = F.when(F.length("data") % np.dtype(dtype).itemsize == 0, F.col("data")).otherwise(cut)
    seen = blocks.where(F.col("data").isNotNull()).select("file", "block", separators(whole_ids, eod, dtype).alias("s"))
    seen = materialize(seen.select("file", "block", F.col("s.n").alias("n"), F.col("s.at").alias("at"), F.size("s.at").cast("long").alias("ends")), "separators")
    briefs = seen.select("file", "block", "n", "ends", F.when(F.col("ends") > 0, F.element_at("at", -1)).cast("long").alias("last"))
    before = materialize(_before(briefs, blocks_per_group), "prefix")
    both = seen.join(before, ["file", "block"])
    begun = F.concat(F.array(F.col("last_before") + 1), F.transform(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda x: F.col("ids_before") + x + 1))
    spans = F.zip_with(begun, F.col("at"), lambda a, b: F.struct(a.alias("start"), (F.col("ids_before") + b - a).alias("n_tokens")))
    out = both.where("ends > 0").select("file", "ends_before", F.posexplode(spans).alias("k", "span"))
    out = out.select("file", (F.col("ends_before") + F.col("k")).alias("nth"), "span.start", "span.n_tokens")
    if not open_end:
        return out
    whole = briefs.join(before, ["file", "block"]).groupBy("file").agg(F.sum("n").alias("n"), F.sum("ends").alias("nth"), F.max(F.greatest(F.col("last_before"), F.when(F.col("ends") > 0, F.col("ids_before") + F.col("last")))).alias("last"))
    return out.unionAll(whole.where("n > last + 1").select("file", "nth", (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens")))


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row ``(doc_id, file, nth, start, n_tokens)`` per input row: texts are written as flat token files,
    these are scanned, and the files' labels name the documents again.

    Null or empty texts have 0 tokens; null and repeated ids are kept; an empty table gives no rows.
    """
    files = materialize(tokenize_to_blocks(docs, id_col, text_col, tokenizer), "tokens", "zstd")
    counts = count_tokens(files)
    prior = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    labels = files.select("file", "block", "ids").withColumn("first", F.coalesce(F.sum(F.size("ids")).over(prior), F.lit(0)))
    named = labels.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select("file", (F.col("first") + F.col("k")).alias("nth"), "doc_id")
    return counts.join(named, ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens")

"""Queries that apply each operator of this subpackage to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import line_dedup, media_gif, mixing, packing, pieces, quality, simhash, spelling, substring_dedup, token_files, url_filter, warc, whitening
from cellgrid.llm.common import table
from cellgrid.plans.shared import materialize

SHINGLE_WORDS = 3
RADIUS = 2
WINDOW = 35
TYPO_EVERY = 199
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle_words=SHINGLE_WORDS, radius=RADIUS)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    stored = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), media_gif.media_of_text(text).alias("content"))
    return stored.select("doc_id", "n_bytes", media_gif.media_digest(F.col("content")).alias("d")).select("doc_id", "n_bytes", "d.*")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=WINDOW)
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixture(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = materialize(warc.write_bundles(table(spark, sf_dir, "pages")), "bundles", "uncompressed")
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.word_counts(table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pieces.encoded(F.col("text")).alias("e"))
    ids = F.col("e.ids")
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    covered = F.coalesce(F.array_max("e.ends"), F.lit(0)).cast("long")
    return found.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), sha(F.array_join(ids.cast("array<string>"), " ")).alias("ids_sha256"), sha(pieces.decoded(ids)).alias("decoded_sha256"), covered.alias("covered_bytes"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_media_gif": op2_media_gif,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_url_filters": op6_url_filters,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_warc_bundles": op10_warc_bundles,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_sentencepiece": op13_sentencepiece,
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
        starts AS (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW}),
        windows AS (SELECT rid, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM starts),
        again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY s) > 1),
        covered AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM again),
        gone AS (SELECT rid, list(p) AS ps, count(*) AS n FROM covered GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (rid)""",
    "op6_url_filters": r"""
        WITH u AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
        SELECT page_id, host, path,
               (SELECT rh || rp FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
               coalesce((SELECT verdict FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict
        FROM u""",
    "op7_line_dedup": rf"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT rid, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
        held AS (SELECT source, line, count(DISTINCT rid) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
        pages AS (SELECT source, count(*) AS n FROM d GROUP BY source),
        bad AS (SELECT held.source, line, true AS bad FROM held JOIN pages ON held.source IS NOT DISTINCT FROM pages.source
                WHERE held.n >= {line_dedup.MIN_PAGES} AND held.n > CAST({line_dedup.RATIO} AS DOUBLE) * pages.n),
        kept AS (SELECT rid, count(bad) AS n, string_agg(l.line, chr(10) ORDER BY i) FILTER (bad IS NULL) AS t
                 FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.line = bad.line GROUP BY rid)
        SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(n AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
        FROM d JOIN kept USING (rid)""",
    "op10_warc_bundles": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = newest THEN NULL ELSE newest END AS refers_to
        FROM g""",
}

"""URL rules by lookup of host-suffix and path-prefix expressions, in Spark's own functions.

Every URL is expanded into the expressions that a rule fitting it could have: each suffix of its host with
as many labels as some rule's host, with each prefix of its path as long as some rule's path.  Expressions meet rules in an
equi-join on the first bytes of their SHA-256; full digests then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a DataFrame."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules with digests: of rules for one expression one stays, block before allow."""
    expression = F.concat("host", "path")
    one = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return one.select(expression.alias("rule"), "verdict", F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("path_chars"), F.sha2(expression, 256).alias("digest"))


def expressions(host: Column, path: Column, label_counts: Column, path_chars: Column) -> Column:
    """Host suffixes of the numbers of labels in ``label_counts`` times path prefixes of the lengths in ``path_chars``, as an array of strings."""
    suffixes = F.transform(F.filter(label_counts, lambda n: n <= F.size(F.split(host, r"\.", -1))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    heads = F.transform(F.filter(path_chars, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row ``(page_id, host, path, rule, verdict)`` per input row.

    A rule fits its host and all subdomains of it if the path starts with the rule's.  The rule with the
    longest ``host + path`` wins, of equally long ones the one that blocks; without any, rule is null and
    verdict is ``default``.  A null URL, or one without ``://``, has empty host and path and fits only a
    rule whose host and path are empty.  Ids are carried, so null and repeated ones do no harm; an empty
    table gives no rows; other columns are ignored.  Each distinct URL is judged once.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    keyed = materialize(keyed_rules(rules), "rules")
    # distinct lengths of rules: at most as many as the longest host has labels and the longest path has characters
    labels, chars = ([F.lit(r[0]) for r in keyed.select(c).distinct().orderBy(c).collect()] for c in ("labels", "path_chars"))
    urls = rows.select("host", "path").distinct()
    asked = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), F.array(*labels).cast("array<int>"), F.array(*chars).cast("array<int>"))).alias("e"))
    asked = asked.select("host", "path", F.sha2("e", 256).alias("asked")).withColumn("prefix", F.substring("asked", 1, PREFIX_HEX))
    met = asked.join(keyed.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX)), "prefix").where("asked = digest")
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "verdict", "rule")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

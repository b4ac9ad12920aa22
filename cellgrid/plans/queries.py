"""Queries that exercise reductions, windows, sets, selection, search, products and arithmetic, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import aggregates as A
from cellgrid.functions import elementwise as E
from cellgrid.operators import generate, histograms, linalg, search, selection, sequences, sets, signal, transforms
from cellgrid.plans.registry import EVENTS, ITEMS, ORACLE_SQL, QUERIES, Query, events, items, query, r, r_binary, read
from cellgrid.plans.registry import vectors as _vectors

# reductions ----------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS avg, round(stddev_samp(l_quantity), 6) AS prms, round(median(l_quantity), 6) AS med, min(l_quantity) AS vmin, max(l_quantity) AS vmax, round(stddev_pop(l_quantity), 6) AS rms FROM lineitem GROUP BY 1""")
def stats_unweighted(spark: SparkSession, d: str) -> DataFrame:
    got = sequences.stats(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return got.select("l_returnflag", *[r(F.col(c)).alias(c) if c not in ("vmin", "vmax") else F.col(c) for c in got.columns[1:]])


@query("""WITH m AS (SELECT l_returnflag, sum(l_quantity * l_tax) / sum(l_tax) AS m FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(any_value(m), 6) AS avg, round(sqrt(sum(l_tax * (l_quantity - m) ** 2) / (sum(l_tax) - 1)), 6) AS prms, median(l_quantity) AS med, min(l_quantity) AS vmin, max(l_quantity) AS vmax,
    round(sum(l_tax * abs(l_quantity - m)) / sum(l_tax), 6) AS adev, round(sqrt(sum(l_tax * (l_quantity - m) ** 2) / sum(l_tax)), 6) AS rms FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def statsover_w(spark: SparkSession, d: str) -> DataFrame:
    got = sequences.statsover(read(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_tax")
    return got.select("l_returnflag", *[r(F.col(c)).alias(c) for c in got.columns[1:]])


@query("SELECT l_orderkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1")
def sumover_qty(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(r(A.sumover("l_quantity"), 2).alias("total"))


@query("SELECT l_orderkey, round(product(1 - l_discount), 6) AS p FROM lineitem GROUP BY 1")
def prodover_disc(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(r(A.prodover(1 - F.col("l_discount"))).alias("p"))


@query("SELECT o_custkey, CAST(sum(o_orderkey)::BIGINT // count(*) AS BIGINT) AS mean_int, round(avg(o_totalprice), 8) AS mean FROM orders GROUP BY 1")
def average_int(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(A.average_int("o_orderkey").cast("long").alias("mean_int"), r(A.average("o_totalprice"), 8).alias("mean"))


@query(f"""SELECT l_orderkey, min(l_extendedprice) AS vmin, max(l_extendedprice) AS vmax, arg_min(i0, (l_extendedprice, i0)) AS min_ind, arg_max(i0, (l_extendedprice, -i0)) AS max_ind FROM {ITEMS} GROUP BY 1""")
def minmaximum_price(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d, "l_extendedprice").groupBy("l_orderkey").agg(*A.minmaximum("l_extendedprice", "i0"))


@query(f"""SELECT l_orderkey, i0, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, i0) - 1 AS nth FROM {ITEMS} QUALIFY nth < 3""")
def maximum_n_ind_price(spark: SparkSession, d: str) -> DataFrame:
    return sequences.extreme_n(items(spark, d, "l_extendedprice"), ["l_orderkey"], "l_extendedprice", "i0", 3)


@query("""SELECT l_returnflag, l_linestatus, median(l_quantity) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1, 2""")
def medover_pctover(spark: SparkSession, d: str) -> DataFrame:
    x, by = read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]
    high = sequences.pctover(x, by, "l_extendedprice", {"p90": 0.9})
    return sequences.medover(x, by, "l_quantity").join(high, by).select(*by, "med", r(F.col("p90"), 4).alias("p90"))


@query("SELECT l_returnflag, median(l_quantity) AS med, round(quantile_cont(l_tax, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")
def percentile_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(A.medover("l_quantity").alias("med"), r(A.pctover("l_tax", 0.9)).alias("p90"))


@query("SELECT l_orderkey, list_sort(list(l_extendedprice))[least(count(*) - 1, CAST(floor(count(*) * 0.3) AS BIGINT)) + 1] AS oddpct FROM lineitem GROUP BY 1")
def oddpctover_price(spark: SparkSession, d: str) -> DataFrame:
    return sequences.oddpctover(read(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", 0.3)


@query("SELECT l_orderkey, quantile_disc(l_quantity, 0.5) AS oddmed FROM lineitem GROUP BY 1")
def oddmedover_qty(spark: SparkSession, d: str) -> DataFrame:
    return sequences.oddpctover(read(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", 0.5, "oddmed", median=True)


@query("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT p_brand, max(n) AS m FROM c GROUP BY 1)
    SELECT p_brand, CAST(CASE WHEN any_value(m) = 1 THEN 0 ELSE min(p_size) END AS BIGINT) AS mode FROM c JOIN b USING (p_brand) WHERE n = m GROUP BY 1""")
def modeover_size(spark: SparkSession, d: str) -> DataFrame:
    return sequences.modeover(read(spark, d, "part"), ["p_brand"], "p_size")


@query(f"""SELECT l_orderkey, CAST(bool_and(l_discount <> 0) AS INT) AS all_on, CAST(bool_or(l_discount <> 0) AS INT) AS any_on, CAST(count_if(l_discount <> 0) % 2 AS INT) AS odd_on, CAST(bool_and(l_discount = 0) AS INT) AS all_zero,
    coalesce(arg_min(l_discount, i0) FILTER (l_discount <> 0), 0) AS first_on FROM {ITEMS} GROUP BY 1""")
def bool_folds(spark: SparkSession, d: str) -> DataFrame:
    v = "l_discount"
    return items(spark, d, v).groupBy("l_orderkey").agg(A.andover(v).alias("all_on"), A.orover(v).alias("any_on"), A.xorover(v).alias("odd_on"), A.zcover(v).alias("all_zero"), A.firstnonzeroover(v, "i0").alias("first_on"))


@query("SELECT l_orderkey, bit_and(l_partkey) AS b_and, bit_or(l_partkey) AS b_or, bit_xor(l_partkey) AS b_xor FROM lineitem GROUP BY 1")
def bit_folds(spark: SparkSession, d: str) -> DataFrame:
    v = "l_partkey"
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(A.bandover(v).alias("b_and"), A.borover(v).alias("b_or"), A.bxorover(v).alias("b_xor"))


@query("SELECT l_orderkey, CAST(count_if(l_discount = 0.05) AS BIGINT) AS nbad, CAST(count_if(l_discount <> 0.05) AS BIGINT) AS ngood, round(sqrt(sum(l_quantity * l_quantity)), 6) AS length FROM lineitem GROUP BY 1")
def nbad_magn(spark: SparkSession, d: str) -> DataFrame:
    v = E.setvaltobad("l_discount", 0.05)
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(A.nbadover(v).alias("nbad"), A.ngoodover(v).alias("ngood"), r(A.magnover("l_quantity")).alias("length"))


@query(f"""SELECT l_orderkey, round(sum(l_quantity * CASE n WHEN 1 THEN 0 WHEN 2 THEN 0.5e0 WHEN 3 THEN [1/3, 4/3, 1/3][i0 + 1] WHEN 4 THEN [3/8, 9/8, 9/8, 3/8][i0 + 1] WHEN 5 THEN [14/45, 64/45, 24/45, 64/45, 14/45][i0 + 1]
    ELSE coalesce([3/8, 7/6, 23/24][CAST(least(i0, n - 1 - i0) + 1 AS INT)], 1e0) END), 6) AS integral FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM {ITEMS}) GROUP BY 1""")
def intover_qty(spark: SparkSession, d: str) -> DataFrame:
    return sequences.intover(items(spark, d, "l_quantity"), ["l_orderkey"], "i0", "l_quantity").select("l_orderkey", r(F.col("integral")).alias("integral"))


# histograms ----------------------------------------------------------------------------------------


@query("""SELECT b AS bin, count(l_orderkey) AS hist FROM range(20) t(b) LEFT JOIN lineitem ON b = greatest(0, least(19, CAST(floor((l_extendedprice - 10000) / 4000) AS BIGINT))) GROUP BY 1""")
def histogram_price(spark: SparkSession, d: str) -> DataFrame:
    return histograms.histogram(read(spark, d, "lineitem"), "l_extendedprice", 4000.0, 10000.0, 20)


@query("""SELECT f.l_returnflag, b AS bin, round(coalesce(sum(l_quantity), 0), 2) AS hist FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN range(12) t(b)
    LEFT JOIN lineitem l ON f.l_returnflag = l.l_returnflag AND b = greatest(0, least(11, CAST(floor(l_tax / 0.01) AS BIGINT))) GROUP BY 1, 2""")
def whistogram_tax(spark: SparkSession, d: str) -> DataFrame:
    got = histograms.histogram(read(spark, d, "lineitem"), "l_tax", 0.01, 0.0, 12, "l_quantity", ["l_returnflag"])
    return got.select("l_returnflag", "bin", r(F.col("hist"), 2).alias("hist"))


@query("""SELECT a AS bin_a, b AS bin_b, count(l_orderkey) AS hist FROM range(5) t(a) CROSS JOIN range(4) u(b) LEFT JOIN lineitem ON a = greatest(0, least(4, CAST(floor(l_quantity / 10) AS BIGINT))) AND b = greatest(0, least(3, CAST(floor((l_extendedprice - 0) / 25000) AS BIGINT))) GROUP BY 1, 2""")
def histogram2d_qty_price(spark: SparkSession, d: str) -> DataFrame:
    return histograms.histogram2d(read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (10.0, 25000.0), (0.0, 0.0), (5, 4))


@query("""WITH p AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / least(100, sqrt(count(*))) AS step FROM orders),
    n AS (SELECT *, greatest(1, CAST(floor((hi - lo) / step + 0.5) AS BIGINT)) AS bins FROM p),
    c AS (SELECT greatest(0, least(bins - 1, CAST(floor((o_totalprice - lo) / step) AS BIGINT))) AS bin, count(*) AS hist FROM orders, n GROUP BY 1)
    SELECT round(lo + (b + 0.5) * step, 4) AS centre, b AS bin, coalesce(hist, 0) AS hist FROM n, unnest(range(bins)) t(b) LEFT JOIN c ON c.bin = b""")
def hist_auto(spark: SparkSession, d: str) -> DataFrame:
    return histograms.hist(read(spark, d, "orders"), "o_totalprice").select(r(F.col("centre"), 4).alias("centre"), "bin", "hist")


@query("""WITH c AS (SELECT greatest(0, least(9, CAST(floor((l_quantity - 1) / 5) AS BIGINT))) AS bin, round(sum(l_tax), 4) AS hist FROM lineitem GROUP BY 1) SELECT 1 + (b + 0.5e0) * 5 AS centre, b AS bin, coalesce(hist, 0) AS hist FROM range(10) t(b) LEFT JOIN c ON c.bin = b""")
def whist_quantity(spark: SparkSession, d: str) -> DataFrame:
    got = histograms.hist(read(spark, d, "lineitem"), "l_quantity", 1.0, 51.0, 5.0, "l_tax")
    return got.select("centre", "bin", r(F.col("hist"), 4).alias("hist"))


@query("SELECT g AS i0, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM (SELECT unnest(range(CAST(max(c_custkey) + 1 AS BIGINT))) AS g FROM customer) LEFT JOIN orders ON o_custkey = g GROUP BY 1")
def indadd_custkey(spark: SparkSession, d: str) -> DataFrame:
    size = read(spark, d, "customer").agg(F.max("c_custkey") + 1).first()[0]
    return histograms.indadd(read(spark, d, "orders"), "o_totalprice", "o_custkey", size).select("i0", r(F.col("total"), 2).alias("total"))


# windows -------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey, i0, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY i0), 2) AS cumusum FROM {ITEMS}")
def cumusumover_qty(spark: SparkSession, d: str) -> DataFrame:
    return sequences.cumusumover(items(spark, d, "l_quantity"), ["l_orderkey"], ["i0"], "l_quantity").select("l_orderkey", "i0", r(F.col("cumusum"), 2).alias("cumusum"))


@query(f"SELECT l_orderkey, i0, round(product(1 + l_tax) OVER (PARTITION BY l_orderkey ORDER BY i0), 6) AS cumuprod FROM {ITEMS}")
def cumuprodover_tax(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d, "l_tax").withColumn("x", 1 + F.col("l_tax"))
    return sequences.cumuprodover(x, ["l_orderkey"], ["i0"], "x").select("l_orderkey", "i0", r(F.col("cumuprod")).alias("cumuprod"))


@query(f"SELECT user_id, i0, round(value - coalesce(lag(value) OVER w, 0), 6) AS numdiff FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY i0)")
def numdiff_events(spark: SparkSession, d: str) -> DataFrame:
    return sequences.numdiff(events(spark, d), ["user_id"], ["i0"], "value").select("user_id", "i0", r(F.col("numdiff")).alias("numdiff"))


@query(f"""SELECT l_orderkey, i0, round(v - coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS diff2
    FROM (SELECT l_orderkey, i0, nullif(l_discount, 0.05) AS v FROM {ITEMS}) QUALIFY i0 > 0""")
def diff2_disc(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d, "l_discount").withColumn("v", E.setvaltobad("l_discount", 0.05))
    return sequences.diff2(x, ["l_orderkey"], ["i0"], "v").select("l_orderkey", "i0", r(F.col("diff2")).alias("diff2"))


@query(f"""SELECT user_id, i0, round((coalesce(lead(value) OVER w, first_value(value) OVER f) - coalesce(lag(value) OVER w, last_value(value) OVER f)) / 2, 6) AS diffcentred FROM {EVENTS}
    WINDOW w AS (PARTITION BY user_id ORDER BY i0), f AS (PARTITION BY user_id ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def diffcentred_events(spark: SparkSession, d: str) -> DataFrame:
    return sequences.diffcentred(events(spark, d), ["user_id"], ["i0"], "value").select("user_id", "i0", r(F.col("diffcentred")).alias("diffcentred"))


@query(f"""SELECT l_orderkey, i0, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY i0), 0) AS locf FROM (SELECT l_orderkey, i0, nullif(l_discount, 0.05) AS v FROM {ITEMS})""")
def locf_disc(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d, "l_discount").withColumn("v", E.setvaltobad("l_discount", 0.05))
    return sequences.locf(x, ["l_orderkey"], ["i0"], "v").select("l_orderkey", "i0", "locf")


@query(f"SELECT user_id, i0, value AS lag0, lag(value, 2) OVER w AS lag1, lag(value, 4) OVER w AS lag2 FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY i0) QUALIFY i0 >= 4")
def lags_events(spark: SparkSession, d: str) -> DataFrame:
    return sequences.lags(events(spark, d), ["user_id"], ["i0"], "value", 2, 3).select("user_id", "i0", "lag0", "lag1", "lag2")


@query(f"SELECT l_orderkey, (i0 + 2) % count(*) OVER (PARTITION BY l_orderkey) AS i0, l_quantity FROM {ITEMS}")
def rotate_items(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rotate(items(spark, d, "l_quantity"), ["l_orderkey"], "i0", 2)


@query(f"""WITH e AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM {EVENTS})
    SELECT user_id, (i0 + k - 1 + n) % n AS i0, round(sum(value * x), 6) AS conv1d FROM e CROSS JOIN (VALUES (0, 0.25e0), (1, 0.5e0), (2, 0.25e0)) t(k, x) GROUP BY 1, 2""")
def conv1d_events(spark: SparkSession, d: str) -> DataFrame:
    return sequences.conv1d(events(spark, d), ["user_id"], "i0", "value", [0.25, 0.5, 0.25]).select("user_id", "i0", r(F.col("conv1d")).alias("conv1d"))


@query(f"""WITH e AS (SELECT user_id, i0, value, count(*) OVER (PARTITION BY user_id) AS n FROM {EVENTS}),
    a AS (SELECT user_id, n, i0 + k AS t, i0, x FROM e CROSS JOIN (VALUES (-1, 0.3e0), (0, 0.5e0), (1, 0.2e0)) t(k, x)),
    m AS (SELECT user_id, i0, x, CASE WHEN t < 0 THEN -t - 1 WHEN t >= n THEN 2 * n - 1 - t ELSE t END AS src FROM a)
    SELECT m.user_id, m.i0, round(sum(x * value), 6) AS conv1d FROM m JOIN e ON e.user_id = m.user_id AND e.i0 = src GROUP BY 1, 2""")
def conv1d_reflect(spark: SparkSession, d: str) -> DataFrame:
    return sequences.conv1d(events(spark, d), ["user_id"], "i0", "value", [0.2, 0.5, 0.3], reflect=True).select("user_id", "i0", r(F.col("conv1d")).alias("conv1d"))


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1 AS rank FROM customer")
def qsorti_acctbal(spark: SparkSession, d: str) -> DataFrame:
    return sequences.qsorti(read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", ["c_custkey"]).select("c_custkey", "rank")


# runs and sets -------------------------------------------------------------------------------------

RUNS = f"""SELECT l_orderkey, sum(new) OVER (PARTITION BY l_orderkey ORDER BY i0) AS run, l_returnflag, l_linenumber, i0 FROM
    (SELECT *, CASE WHEN i0 = 0 OR l_returnflag = lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY i0) THEN 0 ELSE 1 END AS new FROM {ITEMS})"""


@query(f"SELECT l_orderkey, CAST(run AS BIGINT) AS run, count(*) AS len, any_value(l_returnflag) AS value FROM ({RUNS}) GROUP BY 1, 2")
def rle_flags(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rle(items(spark, d, "l_returnflag"), ["l_orderkey"], ["i0"], "l_returnflag")


@query(f"SELECT l_orderkey, i0, l_returnflag AS value FROM {ITEMS}")
def rld_flags(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rld(sequences.rle(items(spark, d, "l_returnflag"), ["l_orderkey"], ["i0"], "l_returnflag"), ["l_orderkey"])


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, i0, CASE WHEN i0 = 0 OR l_linenumber = lag(l_linenumber) OVER w + 1 THEN 0 ELSE 1 END AS new FROM {ITEMS} WINDOW w AS (PARTITION BY l_orderkey ORDER BY i0))
    SELECT l_orderkey, run, count(*) AS len, min(l_linenumber) AS start FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY i0) AS BIGINT) AS run FROM m) GROUP BY 1, 2""")
def rleseq_lines(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rleseq(items(spark, d, "l_linenumber"), ["l_orderkey"], ["i0"], "l_linenumber")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS k FROM orders")
def enumvec_orders(spark: SparkSession, d: str) -> DataFrame:
    return sequences.enumvec(read(spark, d, "orders"), ["o_custkey"], ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "k")


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS k FROM part")
def enumvecg_parts(spark: SparkSession, d: str) -> DataFrame:
    return sequences.enumvecg(read(spark, d, "part"), ["p_brand"], ["p_type"]).select("p_partkey", "k")


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def uniq_suppkey(spark: SparkSession, d: str) -> DataFrame:
    return sets.uniq(read(spark, d, "lineitem"), "l_suppkey")


@query("SELECT o_custkey, max(o_orderkey) AS ind FROM orders GROUP BY 1")
def uniqind_custkey(spark: SparkSession, d: str) -> DataFrame:
    return sets.uniqind(read(spark, d, "orders"), "o_custkey", "o_orderkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def uniqvec_flags(spark: SparkSession, d: str) -> DataFrame:
    return sets.uniqvec(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def _two_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = read(spark, d, "lineitem")
    return x.where("l_tax > 0.06").select(F.col("l_partkey").alias("k")), x.where("l_discount > 0.08").select(F.col("l_partkey").alias("k"))


_A, _B = "SELECT l_partkey AS k FROM lineitem WHERE l_tax > 0.06", "SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.08"


@query(f"{_A} INTERSECT {_B}")
def setops_and(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_sets(spark, d)
    return sets.setops(a, "AND", b)


@query(f"{_A} UNION {_B}")
def setops_or(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_sets(spark, d)
    return sets.setops(a, "OR", b)


@query(f"({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A})")
def setops_xor(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two_sets(spark, d)
    return sets.setops(a, "XOR", b)


@query(f"{_A} EXCEPT {_B}")
def setdiff_parts(spark: SparkSession, d: str) -> DataFrame:
    return sets.setdiff(*_two_sets(spark, d))


@query("SELECT c_custkey, CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS INT) AS big FROM customer")
def in_big_spenders(spark: SparkSession, d: str) -> DataFrame:
    big = read(spark, d, "orders").where("o_totalprice > 300000")
    return sets.is_member(read(spark, d, "customer"), "c_custkey", big, "o_custkey", "big").select("c_custkey", "big")


# selection and gathering ---------------------------------------------------------------------------


@query("SELECT o_orderkey, CAST(coalesce(nullif(o_orderstatus, 'P') = 'F', false) AS INT) AS side FROM orders")
def which_both_status(spark: SparkSession, d: str) -> DataFrame:
    mask = F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F"
    return selection.which_both(read(spark, d, "orders"), mask, "o_orderkey")


@query(f"""SELECT l_orderkey, list_resize(coalesce(list(i0 ORDER BY i0) FILTER (l_discount > 0.05), []), count(*), -1) AS inds FROM {ITEMS} GROUP BY 1""")
def whichover_disc(spark: SparkSession, d: str) -> DataFrame:
    return selection.whichover(items(spark, d, "l_discount"), ["l_orderkey"], F.col("l_discount") > 0.05, "i0")


@query("SELECT o_orderkey, n_name AS value FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def index_lut(spark: SparkSession, d: str) -> DataFrame:
    probe = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return selection.index_nd(read(spark, d, "nation"), ["n_nationkey"], "n_name", probe, [F.col("c_nationkey")], [25]).select("o_orderkey", "value")


@query("""WITH p AS (SELECT s_suppkey, s_nationkey + 20 AS k FROM supplier) SELECT s_suppkey, (SELECT n_name FROM nation WHERE n_nationkey = CASE WHEN k % 50 < 25 THEN k % 50 ELSE 49 - k % 50 END) AS mirrored, (SELECT n_name FROM nation WHERE n_nationkey = k % 25) AS wrapped,
    (SELECT n_name FROM nation WHERE n_nationkey = least(24, k)) AS extended, (SELECT n_name FROM nation WHERE n_nationkey = k) AS truncated FROM p""")
def indexnd_boundaries(spark: SparkSession, d: str) -> DataFrame:
    probe = read(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") + 20).alias("k"))
    nation = read(spark, d, "nation")
    for name, rule in (("mirrored", "mirror"), ("wrapped", "periodic"), ("extended", "extend"), ("truncated", "truncate")):
        probe = selection.index_nd(nation, ["n_nationkey"], "n_name", probe, [F.col("k")], [25], rule, name)
    return probe.drop("k")


@query("SELECT s_suppkey, o AS o0, n_name AS value FROM supplier CROSS JOIN range(3) t(o) LEFT JOIN nation ON n_nationkey = s_nationkey + o")
def range_window(spark: SparkSession, d: str) -> DataFrame:
    probe = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    return selection.range_nd(read(spark, d, "nation"), ["n_nationkey"], "n_name", probe, ["k"], [3], [25]).select("s_suppkey", "o0", "value")


@query(f"SELECT l_orderkey, (i0 - 1) // 2 AS i0, l_quantity FROM {ITEMS} WHERE i0 BETWEEN 1 AND 5 AND (i0 - 1) % 2 = 0")
def slice_step(spark: SparkSession, d: str) -> DataFrame:
    return selection.slice_dim(items(spark, d, "l_quantity"), "i0", 1, 5, 2)


@query(f"SELECT l_orderkey, 3 - i0 AS i0, l_quantity FROM {ITEMS} WHERE i0 <= 3")
def slice_reverse(spark: SparkSession, d: str) -> DataFrame:
    return selection.slice_dim(items(spark, d, "l_quantity"), "i0", 3, 0)


@query(f"SELECT l_orderkey, k AS i0, l_quantity FROM {ITEMS} JOIN (VALUES (2, 0), (0, 1), (2, 2)) t(p, k) ON p = i0")
def dice_items(spark: SparkSession, d: str) -> DataFrame:
    return selection.dice(items(spark, d, "l_quantity"), "i0", [2, 0, 2])


@query("SELECT s_suppkey * 25 + s_nationkey AS flat, s_suppkey * 25 // 25 AS i1, s_nationkey AS i0 FROM supplier")
def clump_splitdim(spark: SparkSession, d: str) -> DataFrame:
    flat = selection.clump(read(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 25, "flat")
    back = selection.one2nd(F.col("flat"), [25, 10**9])
    return flat.select("flat", back[1].alias("i1"), back[0].cast("int").alias("i0"))


@query("SELECT s_suppkey * 25 + s_nationkey AS flat, s_suppkey AS i1, CAST(s_nationkey AS BIGINT) AS i0 FROM supplier")
def splitdim_keys(spark: SparkSession, d: str) -> DataFrame:
    flat = selection.clump(read(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", 25, "f")
    return selection.splitdim(flat.withColumn("flat", F.col("f")), "f", 25, "i0", "i1").select("flat", F.col("i1").cast("long").alias("i1"), F.col("i0").cast("long").alias("i0"))


@query("SELECT n_nationkey AS i0, n_name AS v FROM nation UNION ALL SELECT r_regionkey + 25, r_name FROM region")
def append_names(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "nation").select(F.col("n_nationkey").alias("i0"), F.col("n_name").alias("v"))
    b = read(spark, d, "region").select(F.col("r_regionkey").alias("i0"), F.col("r_name").alias("v"))
    return selection.append(a, b, "i0", 25)


@query("SELECT g AS n_nationkey, coalesce(n_regionkey, 0) AS n_regionkey FROM range(40) t(g) LEFT JOIN nation ON n_nationkey = g")
def reshape_grow(spark: SparkSession, d: str) -> DataFrame:
    return selection.reshape(read(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_regionkey"), "n_nationkey", "n_regionkey", 40)


# search --------------------------------------------------------------------------------------------

KNOTS = "(SELECT p_retailprice AS x, sum(p_size) AS y FROM part GROUP BY 1)"


def _knots(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").groupBy(F.col("p_retailprice").alias("x")).agg(F.sum("p_size").cast("double").alias("y"))


def _vsearch(mode: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        probes = read(spark, d, "part").select("p_partkey", (F.col("p_retailprice") + F.col("p_partkey") % 2 / 100).alias("v"))
        return search.vsearch(_knots(spark, d), "x", probes, "v", mode).select("p_partkey", "found")

    run.__name__ = f"vsearch_{mode}"
    return run


for _mode, _sql in {
    "insert_leftmost": "below",
    "insert_rightmost": "upto",
    "sample": "least(below, (SELECT max(k) FROM n) - 1)",
    "match": "CASE WHEN upto > below THEN upto - 1 ELSE -upto - 1 END",
    "bin_inclusive": "upto - 1",
    "bin_exclusive": "below - 1",
}.items():
    query(f"""WITH n AS (SELECT x, row_number() OVER (ORDER BY x) AS k FROM {KNOTS}), p AS (SELECT p_partkey, p_retailprice + p_partkey % 2 / 100 AS v FROM part),
        f AS (SELECT p_partkey, coalesce(k, 0) AS upto, coalesce(k, 0) - CAST(coalesce(x = v, false) AS INT) AS below FROM p ASOF LEFT JOIN n ON p.v >= n.x)
        SELECT p_partkey, CAST({_sql} AS BIGINT) AS found FROM f""")(_vsearch(_mode))


@query(f"""WITH k AS (SELECT x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, row_number() OVER w AS n FROM {KNOTS} WINDOW w AS (ORDER BY x)), e AS (SELECT min(x) AS lo, max(x) AS hi, max(n) AS m FROM k),
    p AS (SELECT p_partkey, p_retailprice * 1.02 - 15 AS v FROM part), f AS (SELECT p_partkey, v, coalesce(n, 0) AS n FROM p ASOF LEFT JOIN k ON p.v >= k.x)
    SELECT p_partkey, round(k.y + (v - k.x) * (k.y1 - k.y) / (k.x1 - k.x), 4) AS yi, CAST(v < lo OR v > hi AS INT) AS err FROM f, e JOIN k ON k.n = greatest(1, least(e.m - 1, f.n))""")
def interpolate_price(spark: SparkSession, d: str) -> DataFrame:
    probes = read(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 1.02 - 15).alias("v"))
    return search.interpolate(_knots(spark, d), "x", "y", probes, "v").select("p_partkey", r(F.col("yi"), 4).alias("yi"), "err")


@query("""SELECT e.event_id, coalesce(p.event_id, -1) AS prev FROM events e ASOF LEFT JOIN (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_purchase(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    marked = e.withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id") + 1))
    return sequences.locf(marked, ["user_id"], ["ts", "event_id"], "p", "prev").select("event_id", (F.col("prev") - 1).alias("prev"))


# linear algebra ------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 6) AS dot, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cos FROM embeddings, q""")
def inner_vcos(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = v.orderBy("vec_id").limit(1).select(F.col("e").alias("q"))  # one row
    return v.crossJoin(F.broadcast(q)).select("vec_id", r(E.inner(F.col("e"), F.col("q"))).alias("dot"), r(E.vcos(F.col("e"), F.col("q"))).alias("cos"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS unit_sum FROM embeddings")
def norm_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("vec_id", r(F.aggregate(E.norm(F.col("e")), F.lit(0.0), lambda s, x: s + x)).alias("unit_sum"))


@query("""WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT a.i, b.i AS j, round(sum(a.v * b.v), 4) AS v FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2""")
def matmult_gram(spark: SparkSession, d: str) -> DataFrame:
    return linalg.gram(_vectors(spark, d), "e").select("i", "j", r(F.col("v"), 4).alias("v"))


MATS = "WITH a AS (SELECT l_suppkey AS i, l_linenumber AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT l_linenumber AS i, l_partkey % 50 AS j, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2)"


def _mats(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = read(spark, d, "lineitem")
    a = x.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("j")).agg(F.sum("l_quantity").alias("v"))
    return a, x.groupBy(F.col("l_linenumber").cast("long").alias("i"), (F.col("l_partkey") % 50).alias("j")).agg(F.sum("l_tax").alias("v"))


@query(f"{MATS} SELECT a.i, b.j, round(sum(a.v * b.v), 2) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2")
def matmult_cells(spark: SparkSession, d: str) -> DataFrame:
    return linalg.matmult(*_mats(spark, d)).select("i", "j", r(F.col("v"), 2).alias("v"))


@query(f"""{MATS}, p AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2) SELECT t.i, u.j, round(coalesce(p.v, 0), 2) AS v
    FROM (SELECT unnest(range((SELECT max(i) + 1 FROM a))) AS i) t CROSS JOIN (SELECT unnest(range((SELECT max(j) + 1 FROM b))) AS j) u LEFT JOIN p ON p.i = t.i AND p.j = u.j""")
def matmult_blocks(spark: SparkSession, d: str) -> DataFrame:
    return linalg.block_matmult(*_mats(spark, d), 64).select("i", "j", r(F.col("v"), 2).alias("v"))


@query("SELECT a.n_nationkey AS i, b.r_regionkey AS j, CAST(a.n_regionkey * b.r_regionkey AS BIGINT) AS v FROM nation a, region b")
def outer_keys(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("v"))
    b = read(spark, d, "region").select(F.col("r_regionkey").alias("i"), F.col("r_regionkey").alias("v"))
    return linalg.outer(a, b).withColumn("v", F.col("v").cast("long"))


@query("SELECT vec_id, round(e[2] * e[6] - e[3] * e[5], 6) AS x, round(e[3] * e[4] - e[1] * e[6], 6) AS y, round(e[1] * e[5] - e[2] * e[4], 6) AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def crossp_vectors(spark: SparkSession, d: str) -> DataFrame:
    c = E.crossp(F.slice("e", 1, 3), F.slice("e", 4, 3))
    return _vectors(spark, d).select("vec_id", *[r(F.element_at(c, k + 1)).alias(n) for k, n in enumerate("xyz")])


# elementwise ---------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey - 7 * CAST(floor(o_custkey / 7.0) AS BIGINT) AS m_pos, CAST(-o_custkey - 7 * floor(-o_custkey / 7.0) AS BIGINT) AS m_neg, CAST(o_custkey + 7 * floor(-o_custkey / 7.0) AS BIGINT) AS m_div, CAST(0 AS BIGINT) AS m_zero,
    CAST(-(o_custkey // 7) AS BIGINT) AS quotient FROM orders""")
def modulo_sign(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_custkey")
    seven = F.lit(7).cast("long")
    return read(spark, d, "orders").select("o_orderkey", E.modulo(k, seven).alias("m_pos"), E.modulo(-k, seven).alias("m_neg"), E.modulo(k, -seven).alias("m_div"), E.modulo(k, F.lit(0).cast("long")).alias("m_zero"), E.int_divide(-k, 7).alias("quotient"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax < l_discount THEN -1 WHEN l_tax = l_discount THEN 0 ELSE 1 END AS ship, least(0.06, greatest(0.02, l_tax)) AS clipped, CAST(l_tax >= l_discount AS INT) AS ge,
    round(atan2(l_tax, l_discount), 6) AS angle, CASE WHEN l_discount = 0 THEN NULL ELSE round(l_tax / l_discount, 6) END AS ratio, CASE WHEN l_tax = 0 THEN -1.0 ELSE round(ln(l_tax), 6) END AS lg FROM lineitem""")
def arithmetic(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    ratio = E.setnonfinitetobad(E.divide(a, b))
    lg = E.log(a)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", E.spaceship(a, b).alias("ship"), E.clip(a, 0.02, 0.06).alias("clipped"), E.ge(a, b).alias("ge"), r(F.atan2(a, b)).alias("angle"), r(ratio).alias("ratio"), F.when(lg == -E.INF, -1.0).otherwise(r(lg)).alias("lg"))


@query("SELECT p_partkey, p_partkey & p_size AS b_and, p_partkey | p_size AS b_or, xor(p_partkey, p_size) AS b_xor, ~p_partkey AS b_not, p_partkey << 3 AS left3, p_partkey >> 2 AS right2, CAST(p_size ** 3 AS BIGINT) AS cube FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def bitops(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_partkey"), F.col("p_size").cast("long")
    return read(spark, d, "part").select("p_partkey", E.and2(a, b).alias("b_and"), E.or2(a, b).alias("b_or"), E.xor2(a, b).alias("b_xor"), E.bitnot(a).alias("b_not"), E.shiftleft(a, F.lit(3)).alias("left3"), E.shiftright(a, F.lit(2)).alias("right2"), E.ipow(b, F.lit(3)).alias("cube"))


@query("""SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL OR o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS setbadif, coalesce(nullif(o_totalprice, 1e9), 0) AS toval, CAST(o_orderstatus = 'P' AS INT) AS isbad, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END AS copied FROM orders""")
def badvalues(spark: SparkSession, d: str) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    mask = (status == "F").cast("int")
    return read(spark, d, "orders").select("o_orderkey", E.setbadif("o_totalprice", mask).alias("setbadif"), E.setbadtoval(E.setvaltobad("o_totalprice", 1e9), 0.0).alias("toval"), E.isbad(status).alias("isbad"), E.setbadtoval(E.copybad("o_custkey", status), -1).alias("copied"))


@query("SELECT p_partkey, round(((2 * x - 3) * x + 0.5) * x - 7, 7) AS poly, round((77 * x + 150 * p_size + 29 * 3) / 256, 10) AS grey, CAST(abs(x - p_size) <= 0.2 * abs(p_size) AS INT) AS near FROM (SELECT *, p_retailprice / 50 AS x FROM part)")
def polyval_grey(spark: SparkSession, d: str) -> DataFrame:
    x, s = F.col("p_retailprice") / 50, F.col("p_size").cast("double")
    return read(spark, d, "part").select("p_partkey", r_binary(E.polyval(F.array(*[F.lit(c) for c in (2.0, -3.0, 0.5, -7.0)]), x), 7).alias("poly"), r_binary(E.rgbtogr(x, s, F.lit(3)), 10).alias("grey"), E.approx_artol(x, s, 0.0, 0.2).alias("near"))


@query("SELECT p_partkey, CAST(((p_partkey % 256) + 256) % 256 AS SMALLINT) AS as_byte, CAST((p_partkey * 50 + 32768) % 65536 - 32768 AS SMALLINT) AS as_short, round_even(p_retailprice / 7, 0) AS rounded FROM part")
def conversions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", E.wrap_cast(k, "byte").alias("as_byte"), E.wrap_cast(k * 50, "short").alias("as_short"), E.rint(F.col("p_retailprice") / 7).alias("rounded"))


@query("SELECT o_orderkey, round(re * re - im * im, 4) AS re, round(2 * re * im, 4) AS im, round(sqrt(re * re + im * im), 6) AS size, round(atan2(im, re), 6) AS arg FROM (SELECT o_orderkey, o_totalprice / 1e5 AS re, o_custkey / 1e3 AS im FROM orders)")
def complex_square(spark: SparkSession, d: str) -> DataFrame:
    z = E.czip(F.col("o_totalprice") / 1e5, F.col("o_custkey") / 1e3)
    q = E.cmult(z, z)
    return read(spark, d, "orders").select("o_orderkey", r(E.re(q), 4).alias("re"), r(E.im(q), 4).alias("im"), r(E.cabs(z)).alias("size"), r(E.carg(z)).alias("arg"))


@query("SELECT any_value(1) AS one, CAST(bool_and(l_quantity > 0) AS INT) AS every, CAST(bool_or(l_tax > 0.07) AS INT) AS some, round(sum(l_quantity), 2) AS total, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
def whole_array(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").agg(F.lit(1).alias("one"), A.andover((F.col("l_quantity") > 0).cast("int")).alias("every"), A.orover((F.col("l_tax") > 0.07).cast("int")).alias("some"), r(A.sumover("l_quantity"), 2).alias("total"), A.minimum("l_tax").alias("lo"), A.maximum("l_tax").alias("hi"))


# numpy per packed vector, images and transforms: held against numpy in the tests ------------------------


@query()
def fft_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    z = signal.fft(F.col("e"), F.transform("e", lambda x: x * 0))
    return v.select("vec_id", z.alias("z")).select("vec_id", F.transform("z.re", lambda x: F.round(x, 6)).alias("re"), F.transform("z.im", lambda x: F.round(x, 6)).alias("im"))


@query()
def svd_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("e", k * 8 + 1, 8))
    return _vectors(spark, d).select("vec_id", F.transform(linalg.svd(rows)["s"], lambda x: F.round(x, 6)).alias("s"))


@query("SELECT l_linenumber AS i, CAST(l_quantity AS BIGINT) // 1 % 10 AS j, count(*) AS v FROM lineitem GROUP BY 1, 2")
def image_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("i"), (F.col("l_quantity").cast("long") % 10).alias("j")).agg(F.count("*").alias("v"))


@query("""WITH c AS (SELECT l_linenumber - 1 AS i, CAST(l_quantity AS BIGINT) % 10 AS j, count(*) AS v FROM lineitem GROUP BY 1, 2)
    SELECT (a.i + di + 7) % 7 AS i, (a.j + dj + 10) % 10 AS j, round(sum(v * w), 6) AS v FROM c a CROSS JOIN (SELECT di, dj, CASE WHEN di = 0 AND dj = 0 THEN 0.5e0 ELSE 0.0625e0 END AS w FROM (VALUES (-1), (0), (1)) x(di), (VALUES (-1), (0), (1)) y(dj)) k GROUP BY 1, 2""")
def conv2d_counts(spark: SparkSession, d: str) -> DataFrame:
    img = image_counts(spark, d).select((F.col("i") - 1).alias("i"), "j", "v")
    k = [[0.0625] * 3, [0.0625, 0.5, 0.0625], [0.0625] * 3]
    return signal.conv2d(img, [], (7, 10), k).select(F.col("i").cast("int"), "j", r(F.col("v")).alias("v"))


@query("SELECT c_custkey, round(x, 6) AS x, round(asinh(tan(y)), 6) AS y FROM (SELECT c_custkey, radians(c_nationkey * 10 - 120) AS x, radians(c_custkey % 160 - 80) AS y FROM customer)")
def mercator(spark: SparkSession, d: str) -> DataFrame:
    x, y = transforms.t_mercator().apply(F.radians(F.col("c_nationkey") * 10 - 120), F.radians(F.col("c_custkey") % 160 - 80))
    return read(spark, d, "customer").select("c_custkey", r(x).alias("x"), r(y).alias("y"))


@query("SELECT o_orderkey, round(1 + 3 * CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS DOUBLE) / ((SELECT count(*) FROM orders) - 1), 9) AS v FROM orders")
def xlinvals(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a row, at even distances from 1 to 4."""
    orders = sequences.with_index(read(spark, d, "orders").select("o_orderkey"), [], ["o_orderkey"])
    return orders.join(generate.axislinvals(spark, [orders.count()], 0, 1.0, 4.0), "i0").select("o_orderkey", r(F.col("v"), 9).alias("v"))


# the other modules register their queries when they are imported
from cellgrid.plans import queries_arrays, queries_images, queries_large, queries_sources, queries_values  # noqa: E402, F401

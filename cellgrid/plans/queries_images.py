"""Queries over images: counts of lines by number and quantity, seven by ten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators import signal
from cellgrid.plans.registry import query, r, read

SHAPE = (7, 10)
IMG = "(SELECT CAST(l_linenumber - 1 AS BIGINT) AS i, CAST(l_quantity AS BIGINT) % 10 AS j, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"
NEAR = "(SELECT unnest([-1, 0, 1]) AS di) x, (SELECT unnest([-1, 0, 1]) AS dj) y"


def image(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("i"), (F.col("l_quantity").cast("long") % 10).alias("j"))
    return cells.agg(F.count("*").cast("double").alias("v"))


@query(f"""WITH c AS {IMG}, n AS (SELECT i, j, di, dj FROM c, {NEAR}) SELECT n.i, n.j, median(a.v) AS v FROM n JOIN c a ON a.i = greatest(0, least(6, n.i + di)) AND a.j = greatest(0, least(9, n.j + dj)) GROUP BY 1, 2""")
def med2d_counts(spark: SparkSession, d: str) -> DataFrame:
    return signal.med2d(image(spark, d), [], SHAPE, 3, 3, "replicate")


@query(f"""WITH c AS {IMG} SELECT c.i, c.j, round(CASE WHEN c.i BETWEEN 1 AND 5 AND c.j BETWEEN 1 AND 8 THEN (SELECT sum(a.v) / 9 FROM c a WHERE abs(a.i - c.i) <= 1 AND abs(a.j - c.j) <= 1) ELSE v END, 6) AS v FROM c""")
def box2d_counts(spark: SparkSession, d: str) -> DataFrame:
    return signal.box2d(image(spark, d), [], SHAPE, 3, 3).select("i", "j", r(F.col("v")).alias("v"))


@query(f"""WITH c AS (SELECT i, j, CASE WHEN (i * 3 + j) % 4 = 0 THEN NULL ELSE v END AS v FROM {IMG}) SELECT c.i, c.j, round(coalesce(v, (SELECT avg(a.v) FROM c a WHERE abs(a.i - c.i) <= 1 AND abs(a.j - c.j) <= 1)), 6) AS v FROM c""")
def patch2d_counts(spark: SparkSession, d: str) -> DataFrame:
    holes = image(spark, d).withColumn("v", F.when((F.col("i") * 3 + F.col("j")) % 4 != 0, F.col("v")))
    return signal.patch2d(holes, [], SHAPE).select("i", "j", r(F.col("v")).alias("v"))


@query(f"""WITH c AS {IMG} SELECT max(v) AS v, arg_max(i, (v, -j, -i)) AS i, arg_max(j, (v, -j, -i)) AS j, round(sum(CASE WHEN abs(i - 3) <= 2.5 AND abs(j - 4) <= 2.5 THEN i * v END) / sum(CASE WHEN abs(i - 3) <= 2.5 AND abs(j - 4) <= 2.5 THEN v END), 6) AS ci,
    min(i) FILTER (v > 100) AS i0, max(j) FILTER (v > 100) AS j1 FROM c""")
def image_places(spark: SparkSession, d: str) -> DataFrame:
    img = image(spark, d)
    top, middle = signal.max2d_ind(img, []), signal.centroid2d(img, [], 3.0, 4.0, 5.0).select(r(F.col("ci")).alias("ci"))
    edge = signal.crop(img.withColumn("v", (F.col("v") > 100).cast("int")), []).select("i0", "j1")
    return top.crossJoin(middle).crossJoin(edge)  # one row each


@query(f"""WITH RECURSIVE c AS (SELECT i, j FROM {IMG} WHERE (i * i + 3 * j + i * j) % 5 < 2), reach(i, j, a, b) AS (SELECT i, j, i, j FROM c UNION SELECT reach.i, reach.j, c.i, c.j FROM reach JOIN c ON abs(c.i - a) + abs(c.j - b) = 1),
    roots AS (SELECT i, j, min(a * 10 + b) AS root FROM reach GROUP BY 1, 2), named AS (SELECT i, j, dense_rank() OVER (ORDER BY root) AS label FROM roots)
    SELECT g.i, g.j, CAST(coalesce(label, 0) AS BIGINT) AS label FROM {IMG} g LEFT JOIN named n ON n.i = g.i AND n.j = g.j""")
def components_4(spark: SparkSession, d: str) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    mask = image(spark, d).withColumn("v", ((i * i + 3 * j + i * j) % 5 < 2).cast("int"))
    return signal.label_components(mask, SHAPE, 4).select("i", "j", F.col("label").cast("long").alias("label"))


@query(f"""WITH RECURSIVE c AS (SELECT i, j FROM {IMG} WHERE (i * i + 3 * j + i * j) % 7 < 2), reach(i, j, a, b) AS (SELECT i, j, i, j FROM c UNION SELECT reach.i, reach.j, c.i, c.j FROM reach JOIN c ON greatest(abs(c.i - a), abs(c.j - b)) = 1),
    roots AS (SELECT i, j, min(a * 10 + b) AS root FROM reach GROUP BY 1, 2), named AS (SELECT i, j, dense_rank() OVER (ORDER BY root) AS label FROM roots)
    SELECT g.i, g.j, CAST(coalesce(label, 0) AS BIGINT) AS label FROM {IMG} g LEFT JOIN named n ON n.i = g.i AND n.j = g.j""")
def components_8(spark: SparkSession, d: str) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    mask = image(spark, d).withColumn("v", ((i * i + 3 * j + i * j) % 7 < 2).cast("int"))
    return signal.label_components(mask, SHAPE, 8).select("i", "j", F.col("label").cast("long").alias("label"))


@query(f"""SELECT i, j, CASE WHEN i + j < 7.5 AND j - i < 4.5 AND i - j < 3.5 AND i + j > 1.5 THEN -1 ELSE v END AS v FROM {IMG}""")
def polyfill_counts(spark: SparkSession, d: str) -> DataFrame:
    """A turned rectangle, whose corners are where its four lines meet."""
    return signal.polyfill(image(spark, d), [(1.5, 6.0), (5.5, 2.0), (2.5, -1.0), (-1.5, 3.0)], -1.0)


@query(f"SELECT i // 2 AS i, j // 5 AS j, round(avg(v), 6) AS mean, sum(v) AS total FROM {IMG} GROUP BY 1, 2")
def rebin_counts(spark: SparkSession, d: str) -> DataFrame:
    img = image(spark, d)
    return signal.rebin(img, [], 2, 5).select("i", "j", r(F.col("v")).alias("mean")).join(signal.rebin(img, [], 2, 5, norm=True).withColumnRenamed("v", "total"), ["i", "j"])


@query(f"SELECT CAST(floor(sqrt((i - 3) ** 2 + (j - 4) ** 2)) AS BIGINT) AS r, round(avg(v), 6) AS v FROM {IMG} GROUP BY 1")
def rings(spark: SparkSession, d: str) -> DataFrame:
    return signal.circ_mean(image(spark, d), 3.0, 4.0).select("r", r(F.col("v")).alias("v"))


@query(f"""WITH p AS (SELECT s_suppkey % 9 * 0.5 AS a, s_nationkey % 12 * 0.75 AS b FROM supplier), c AS {IMG}
    SELECT a, b, round((SELECT sum(v * (1 - abs(i - a)) * (1 - abs(j - b))) FROM c WHERE abs(i - a) < 1 AND abs(j - b) < 1), 6) AS value FROM p""")
def resample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Several rows ask for one place: each has its answer."""
    asked = read(spark, d, "supplier").select((F.col("s_suppkey") % 9 * 0.5).alias("a"), (F.col("s_nationkey") % 12 * 0.75).alias("b"))
    return signal.resample(image(spark, d), SHAPE, asked, F.col("a"), F.col("b")).select("a", "b", r(F.col("value")).alias("value"))


@query(f"SELECT i, j, (SELECT a.v FROM {IMG} a WHERE a.i = 6 - c.i AND a.j = 9 - c.j) AS v FROM {IMG} c")
def rot2d_half(spark: SparkSession, d: str) -> DataFrame:
    return signal.rot2d(image(spark, d), SHAPE, 180.0, "sample").select("i", "j", "v")


@query("SELECT n_nationkey, round(2 * n_nationkey + 0.5 * n_regionkey + 1, 5) AS x, round(n_regionkey - 0.25 * n_nationkey * n_regionkey, 5) AS y FROM nation")
def warp_fit(spark: SparkSession, d: str) -> DataFrame:
    u, v = F.col("n_nationkey"), F.col("n_regionkey")
    pairs = read(spark, d, "nation").select("n_nationkey", u.cast("double").alias("u"), v.cast("double").alias("v"), (2 * u + 0.5 * v + 1).alias("x"), (v - 0.25 * u * v).alias("y"))
    fit = signal.fitwarp2d(pairs, "x", "y", "u", "v", 2)
    return pairs.select("n_nationkey", *[r(signal.warp_columns(F.col("u"), F.col("v"), fit[c], 2), 5).alias(c) for c in ("x", "y")])


@query("""WITH c AS (SELECT l_linenumber - 1 AS i, l_suppkey % 5 AS j, l_partkey % 4 AS k, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT s_suppkey, s_suppkey % 12 / 2 AS a, s_nationkey % 8 / 2 AS b, s_nationkey % 6 / 2 AS d FROM supplier)
    SELECT s_suppkey, round(coalesce((SELECT sum(v * (1 - abs(i - a)) * (1 - abs(j - b)) * (1 - abs(k - d))) FROM c WHERE abs(i - a) < 1 AND abs(j - b) < 1 AND abs(k - d) < 1), 0), 6) AS value FROM p""")
def interp_cube(spark: SparkSession, d: str) -> DataFrame:
    cube = read(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("i"), (F.col("l_suppkey") % 5).alias("j"), (F.col("l_partkey") % 4).alias("k")).agg(F.count("*").alias("v"))
    asked = read(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 12 / 2).alias("a"), (F.col("s_nationkey") % 8 / 2).alias("b"), (F.col("s_nationkey") % 6 / 2).alias("c"))
    return signal.interp_nd(cube, ["i", "j", "k"], [7, 5, 4], asked, [F.col("a"), F.col("b"), F.col("c")]).select("s_suppkey", r(F.col("value")).alias("value"))


@query(f"SELECT c.i, c.j, coalesce((SELECT a.v FROM {IMG} a WHERE a.i = c.i + 1 AND a.j = c.j - 2), 0) AS v FROM {IMG} c")
def warp2d_shift(spark: SparkSession, d: str) -> DataFrame:
    """A warp of the first degree that moves the image by a cell down and two to the right."""
    fit = {"x": [1.0, 1.0, 0.0, 0.0], "y": [-2.0, 0.0, 1.0, 0.0]}
    return signal.warp2d(image(spark, d), SHAPE, fit, 2).select("i", "j", "v")


@query("SELECT n_nationkey, CAST(ceil(n_nationkey * sqrt(3) / 2 + n_regionkey / 2 - 1e-9) AS INT) AS rows, CAST(ceil(n_regionkey * sqrt(3) / 2 + n_nationkey / 2 - 1e-9) AS INT) AS columns FROM nation")
def turned_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = {(a, b): signal.rotnewsz((a, b), 30.0) for a in range(25) for b in range(5)}
    known = spark.createDataFrame([(*k, *v) for k, v in sizes.items()], "a int, b int, rows int, columns int")
    return read(spark, d, "nation").join(F.broadcast(known), (F.col("n_nationkey") == F.col("a")) & (F.col("n_regionkey") == F.col("b"))).select("n_nationkey", "rows", "columns")

"""Queries over generators, selection, reshaping, long vectors, runs of vectors and transforms of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import elementwise as E
from cellgrid.operators import generate, linalg, search, selection, sequences, signal
from cellgrid.plans.registry import ITEMS, ORDER, SQL_ORDER, items, query, r, read

# vectors as cells: i0 is the element, i1 the vector
CELLS = "(SELECT CAST(unnest(range(len(embedding))) AS BIGINT) AS i0, vec_id AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("i1"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i0", "v")).select(F.col("i0").cast("long").alias("i0"), "i1", "v")


# generators ----------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT unnest(range(7 * (SELECT count(*) FROM customer))) AS k), c AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i1 FROM customer)
    SELECT CAST(k % 7 AS BIGINT) AS i0, CAST(k // 7 AS BIGINT) AS i1, c_acctbal AS kept, CAST(k AS DOUBLE) AS sequence, CAST(k // 7 AS DOUBLE) AS yvals, round(exp(ln(2) + k % 7 * ln(16) / 6), 6) AS xlog, k % 7 * 10 + k // 7 AS coords, round(sqrt((k % 7 - 3) ** 2 + (k // 7 - (SELECT count(*) FROM customer) // 2) ** 2), 6) AS rvals, 7.5 AS filled FROM g JOIN c ON c.i1 = k // 7""")
def generators(spark: SparkSession, d: str) -> DataFrame:
    """A grid with a row for each customer, whose balance ones and zeroes leave as it is."""
    customers = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    shape, on = [7, customers.count()], ["i0", "i1"]
    made = {"zeroes": generate.zeroes(spark, shape), "ones": generate.ones(spark, shape), "sequence": generate.sequence(spark, shape), "yvals": generate.axisvals(spark, shape, 1), "xlog": generate.axislogvals(spark, shape, 0, 2.0, 32.0), "coords": generate.ndcoords(spark, shape), "rvals": generate.rvals(spark, shape), "filled": generate.constant(spark, shape, 7.5)}
    out = None
    for name, df in made.items():
        v = F.col("v")[0] * 10 + F.col("v")[1] if name == "coords" else r(F.col("v"))
        part = df.select(*on, v.alias(name))
        out = part if out is None else out.join(part, on)
    held = sequences.with_index(customers, [], ["c_custkey"]).select(F.col("i0").alias("i1"), "c_acctbal")
    return out.join(held, "i1").withColumn("kept", F.col("c_acctbal") * F.col("ones") + F.col("zeroes")).select(*on, "kept", "sequence", "yvals", "xlog", "coords", "rvals", "filled")


@query("SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, s_acctbal AS v FROM supplier")
def identity_cells(spark: SparkSession, d: str) -> DataFrame:
    """The identity times the suppliers' balances."""
    balances = read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.col("s_acctbal").alias("v"))
    one = generate.identity(spark, balances.agg(F.max("i")).first()[0] + 1)
    return linalg.matmult(one.where("v != 0").withColumnsRenamed({"i0": "i", "i1": "j"}), balances)


@query("SELECT CAST(s_suppkey AS BIGINT) AS i0, CAST(s_suppkey AS BIGINT) AS i1, s_acctbal AS v FROM supplier")
def stretcher_balances(spark: SparkSession, d: str) -> DataFrame:
    return generate.stretcher(read(spark, d, "supplier").select(F.col("s_suppkey").alias("i0"), F.col("s_acctbal").alias("v")))


@query("SELECT a.n_nationkey AS i0, a.n_name AS v0, b.r_regionkey AS i1, b.r_name AS v1 FROM nation a, region b")
def meshgrid_names(spark: SparkSession, d: str) -> DataFrame:
    return generate.meshgrid([read(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("v")), read(spark, d, "region").select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("v"))])


@query("WITH RECURSIVE f(i0, v, w) AS (SELECT CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i0 + 1, w, v + w FROM f WHERE i0 < 60) SELECT p_partkey, v FROM part JOIN f ON i0 = p_size")
def fibonacci_numbers(spark: SparkSession, d: str) -> DataFrame:
    """For each part the number at the place of its size."""
    parts = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("i0"))
    return parts.join(generate.fibonacci(spark, parts.agg(F.max("i0")).first()[0] + 1), "i0").select("p_partkey", "v")


@query("SELECT 40 * count(*) AS n, true AS inside, true AS strictly, true AS centred FROM customer")
def random_cells(spark: SparkSession, d: str) -> DataFrame:
    """Forty values for each customer, and whether they are spread as they should."""
    shape = [40, read(spark, d, "customer").count()]
    u, s, g = (generate.random(spark, shape, 7), generate.randsym(spark, shape, 7), generate.random(spark, shape, 7, normal=True))
    inside = u.agg(F.count("*").alias("n"), (F.bool_and((F.col("v") >= 0) & (F.col("v") < 1)) & (F.abs(F.avg("v") - 0.5) < 0.05)).alias("inside"))
    return inside.crossJoin(s.agg(F.bool_and((F.col("v") > 0) & (F.col("v") < 1)).alias("strictly"))).crossJoin(g.agg(((F.abs(F.avg("v")) < 0.1) & (F.abs(F.stddev("v") - 1) < 0.1)).alias("centred")))  # one row each


@query("""WITH p AS (SELECT n_regionkey AS i1, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i0, CAST(n_nationkey AS DOUBLE) AS v FROM nation WHERE n_nationkey > 2), n AS (SELECT max(i0) AS m FROM p)
    SELECT CAST(g.i0 AS BIGINT) AS i0, CAST(r_regionkey AS BIGINT) AS i1, coalesce(v, -1) AS v FROM region CROSS JOIN (SELECT unnest(range(m + 1)) AS i0 FROM n) g LEFT JOIN p ON p.i0 = g.i0 AND p.i1 = r_regionkey""")
def literal_cells(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region, without the first three, as a nested list, short ones filled with -1."""
    held = read(spark, d, "nation").where("n_nationkey > 2").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("ns")).orderBy("n_regionkey")
    lists = [[float(x) for x in row["ns"]] for row in held.collect()]
    return generate.literal(spark, lists, -1.0).unionAll(generate.empty(spark, 2))


@query("SELECT c_custkey, round(radians(c_custkey * 7 % 360 // 30 * 30 - 180), 6) AS lon, round(radians(c_custkey * 11 % 181 - 90), 6) AS lat, round(radians(c_custkey * 13 % 361 - 180), 6) AS along FROM customer")
def graticule(spark: SparkSession, d: str) -> DataFrame:
    """The points of a meridian and of the equator that each customer is sent to."""
    points = generate.earth_graticule(spark, 30)
    at = read(spark, d, "customer").select("c_custkey", F.floor(F.col("c_custkey") * 7 % 360 / 30).alias("line"), (F.col("c_custkey") * 11 % 181).cast("long").alias("nth"), (F.col("c_custkey") * 13 % 361).cast("long").alias("k"))
    equator = points.where("line = 15").select(F.col("nth").alias("k"), F.col("lon").alias("along"))
    return at.join(points, ["line", "nth"]).join(equator, "k").select("c_custkey", *[r(F.col(c)).alias(c) for c in ("lon", "lat", "along")])


# selection -----------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def which_orders(spark: SparkSession, d: str) -> DataFrame:
    return selection.which(read(spark, d, "orders"), F.col("o_totalprice") > 200000, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS side FROM orders")
def where_orders(spark: SparkSession, d: str) -> DataFrame:
    yes, no = selection.where_both(read(spark, d, "orders"), F.col("o_totalprice") > 200000)
    same = selection.where(yes, F.col("o_totalprice") > 0)
    return same.select("o_orderkey", F.lit(1).alias("side")).unionAll(no.select("o_orderkey", F.lit(0).alias("side")))


@query(f"SELECT l_orderkey, i0, CAST(l_tax > 0.04 AS INT) AS side FROM {ITEMS}")
def whichnd_tax(spark: SparkSession, d: str) -> DataFrame:
    yes, no = selection.which_nd_both(items(spark, d, "l_tax"), F.col("l_tax") > 0.04, ["l_orderkey", "i0"])
    return yes.withColumn("side", F.lit(1)).unionAll(no.withColumn("side", F.lit(0)))


@query(f"SELECT l_orderkey, i0, l_tax, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS side FROM {ITEMS} JOIN orders ON l_orderkey = o_orderkey")
def wherend_tax(spark: SparkSession, d: str) -> DataFrame:
    mask = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") > 200000).alias("v"))
    known = selection.where_nd(items(spark, d, "l_tax"), mask.withColumn("v", F.lit(1)), ["l_orderkey"])
    yes, no = selection.where_nd_both(known, mask, ["l_orderkey"])
    return yes.withColumn("side", F.lit(1)).unionAll(no.withColumn("side", F.lit(0)))


@query("""WITH t AS (SELECT l_linenumber - 1 AS a, l_suppkey - 1 AS b, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), m AS (SELECT max(b) + 1 AS n FROM t)
    SELECT o_orderkey, round(v, 2) AS value FROM orders, m LEFT JOIN t ON t.a = o_custkey % 7 AND t.b = o_orderkey % m.n""")
def index2d_orders(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("a"), (F.col("l_suppkey") - 1).alias("b")).agg(F.sum("l_quantity").alias("v"))
    n = t.agg(F.max("b")).first()[0] + 1
    return selection.index_nd(t, ["a", "b"], "v", read(spark, d, "orders"), [F.col("o_custkey") % 7, F.col("o_orderkey") % n], [7, n]).select("o_orderkey", r(F.col("value"), 2).alias("value"))


@query(f"SELECT l_orderkey, i0 - 1 AS i0, l_tax FROM {ITEMS} WHERE i0 BETWEEN 1 AND 3")
def sec_items(spark: SparkSession, d: str) -> DataFrame:
    return selection.slice_dim(items(spark, d, "l_tax"), "i0", 1, 3)


@query(f"SELECT i0, i1, CASE WHEN i0 BETWEEN 1 AND 3 AND i1 BETWEEN 2 AND 41 THEN 1.0 ELSE v END AS v FROM {CELLS}")
def insert_block(spark: SparkSession, d: str) -> DataFrame:
    return selection.insert(_cells(spark, d), generate.ones(spark, [3, 40]), ["i0", "i1"], "v", [1, 2])


@query(f"SELECT i0, i1, CASE WHEN i0 = 2 AND i1 = 1 THEN NULL ELSE v END AS v FROM {CELLS}")
def setbadat_cell(spark: SparkSession, d: str) -> DataFrame:
    return selection.setbadat(_cells(spark, d), ["i0", "i1"], [2, 1], "v")


# reshaping -----------------------------------------------------------------------------------------

_SUMS = "(SELECT l_linenumber - 1 AS i, l_suppkey % 7 AS j, round(sum(l_quantity), 2) AS v FROM lineitem GROUP BY 1, 2)"


def _sums(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("i"), (F.col("l_suppkey") % 7).alias("j")).agg(r(F.sum("l_quantity"), 2).alias("v"))


@query(f"SELECT i, v FROM {_SUMS} WHERE i = j")
def diagonal_sums(spark: SparkSession, d: str) -> DataFrame:
    return selection.diagonal(_sums(spark, d), "i", "j")


@query(f"SELECT CAST(j AS BIGINT) AS i, CAST(i AS INT) AS j, v FROM {_SUMS}")
def xchg_sums(spark: SparkSession, d: str) -> DataFrame:
    return selection.xchg(_sums(spark, d), "i", "j")


@query(f"SELECT i1 AS a, CAST(0 AS BIGINT) AS b, i0 AS c, v FROM {CELLS}")
def mv_reorder(spark: SparkSession, d: str) -> DataFrame:
    x = _cells(spark, d).withColumnsRenamed({"i0": "a", "i1": "b"}).select("a", "b", F.lit(0).cast("long").alias("c"), "v")
    return selection.reorder(selection.mv(x, ["a", "b", "c"], 0, -1), ["a", "b", "c"], [0, 1, 2])


@query(f"SELECT i0, CASE i1 WHEN 1 THEN 0 ELSE 1 END AS part, v FROM {CELLS} WHERE i1 IN (1, 3)")
def squeeze_using(spark: SparkSession, d: str) -> DataFrame:
    x = _cells(spark, d).withColumn("i2", F.lit(0).cast("long"))
    x = selection.squeeze(x, {"i0": 64, "i1": read(spark, d, "embeddings").count(), "i2": 1})
    a, b = selection.using(x, "i1", [1, 3])
    return a.withColumn("part", F.lit(0)).unionAll(b.withColumn("part", F.lit(1)))


@query("SELECT n_nationkey + 25 * t AS i, n_name AS v FROM nation, range(3) u(t)")
def dup_names(spark: SparkSession, d: str) -> DataFrame:
    return selection.dup(read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_name").alias("v")), "i", 25, 3)


@query(f"SELECT i0 * 2 + a AS i0, i1 * 3 + b AS i1, v FROM {CELLS}, range(2) t(a), range(3) u(b)")
def inflate_cells(spark: SparkSession, d: str) -> DataFrame:
    return selection.inflate_n(_cells(spark, d), {"i0": 2, "i1": 3})


@query(f"SELECT i0 + 64 * a AS i0, i1 + (SELECT count(*) FROM embeddings) * b AS i1, v FROM {CELLS}, range(2) w(a), range(3) x(b)")
def dupn_cells(spark: SparkSession, d: str) -> DataFrame:
    return selection.dup_n(_cells(spark, d), {"i0": (64, 2), "i1": (read(spark, d, "embeddings").count(), 3)})


@query("SELECT n_regionkey, n_name, CAST(t AS BIGINT) AS copy FROM nation, range(2) u(t)")
def dummy_names(spark: SparkSession, d: str) -> DataFrame:
    return selection.dummy(read(spark, d, "nation").select("n_regionkey", "n_name"), 2, "copy")


@query("SELECT c_custkey AS i, c_name AS v, CAST(0 AS BIGINT) AS k FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier")
def cat_dog(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.col("c_name").alias("v"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_name").alias("v"))
    parts = selection.dog(selection.cat([a, b], "k"), "k", 2)
    return selection.cat(parts, "k")


@query(f"SELECT i0 AS i, i1 + t * (SELECT count(*) FROM embeddings) AS j, v * (1 + t) AS v FROM {CELLS}, range(2) u(t) UNION ALL SELECT i0 + 64, i1, -v FROM {CELLS} WHERE i0 < 64")
def stacked_cells(spark: SparkSession, d: str) -> DataFrame:
    """Twice the vectors beside themselves, and their negatives below."""
    x, n = _cells(spark, d).withColumnsRenamed({"i0": "i", "i1": "j"}), read(spark, d, "embeddings").count()
    wide = selection.augment([x, x.withColumn("v", F.col("v") * 2)], [n, n])
    return selection.mstack([wide, x.withColumn("v", -F.col("v"))], [64, 64])


@query(f"SELECT i0 + 64 * t AS i0, i1, v + 100 * t AS v FROM {CELLS}, range(3) u(t)")
def glue_grids(spark: SparkSession, d: str) -> DataFrame:
    x = _cells(spark, d)
    return selection.glue([x, x.withColumn("v", F.col("v") + 100), x.withColumn("v", F.col("v") + 200)], "i0", [64, 64, 64])


@query(f"SELECT CAST(least(i, j) AS BIGINT) AS a, CAST(greatest(i, j) AS BIGINT) AS b, v FROM {_SUMS} WHERE i <= j UNION ALL SELECT CAST(j AS BIGINT), CAST(i AS BIGINT), v FROM {_SUMS} WHERE i < j")
def triangle_sums(spark: SparkSession, d: str) -> DataFrame:
    low = selection.tritosquare(selection.squaretotri(_sums(spark, d), "i", "j", "v"), "v")
    return selection.tritosym(low, "i", "j", "v").select(F.col("i").alias("a"), F.col("j").alias("b"), "v")


@query("WITH t AS (SELECT n_nationkey AS i, n_regionkey AS j, CAST(1 AS DOUBLE) AS v FROM nation) SELECT i * 2 + k AS i, j * 2 + l AS j, v * (k + 2 * l) AS v FROM t, range(2) a(k), range(2) b(l)")
def kronecker_names(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"), F.lit(1.0).alias("v"))
    b = generate.grid(spark, [2, 2]).select(F.col("i0").alias("i"), F.col("i1").alias("j"), (F.col("i0") + 2 * F.col("i1")).alias("v"))
    return linalg.kroneckerproduct(a, b, 2, 2)


@query(f"SELECT round(sum(v), 2) AS trace FROM {_SUMS} WHERE i = j")
def trace_sums(spark: SparkSession, d: str) -> DataFrame:
    return linalg.trace(_sums(spark, d)).select(r(F.col("trace"), 2).alias("trace"))


# one long vector -----------------------------------------------------------------------------------

LONG = f"(SELECT row_number() OVER (ORDER BY l_orderkey, {SQL_ORDER}) - 1 AS i0, * FROM lineitem)"
ALL = ["l_orderkey", *ORDER]


def _long(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return sequences.with_index(read(spark, d, "lineitem").select(*dict.fromkeys([*ALL, *columns])), [], ALL, keep=list(columns)).select("i0", *columns)


@query(f"""SELECT i0, round(sum(l_quantity) OVER w, 2) AS cumusum, coalesce(last_value(nullif(l_discount, 0.05) IGNORE NULLS) OVER w, 0) AS locf, round(l_quantity - coalesce(lag(l_quantity) OVER w, 0), 2) AS numdiff,
    round((coalesce(lead(l_quantity) OVER w, first_value(l_quantity) OVER f) - coalesce(lag(l_quantity) OVER w, last_value(l_quantity) OVER f)) / 2, 2) AS centred FROM {LONG}
    WINDOW w AS (ORDER BY i0), f AS (ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def long_scans(spark: SparkSession, d: str) -> DataFrame:
    x = _long(spark, d, "l_quantity", "l_discount").withColumn("v", E.setvaltobad("l_discount", 0.05))
    seen = sequences.along(x, "i0", {"cumusum": ("cumusumover", "l_quantity"), "locf": ("locf", "v"), "numdiff": ("numdiff", "l_quantity"), "centred": ("diffcentred", "l_quantity")})
    return seen.select("i0", r(F.col("cumusum"), 2).alias("cumusum"), "locf", r(F.col("numdiff"), 2).alias("numdiff"), r(F.col("centred"), 2).alias("centred"))


@query(f"SELECT i0, l_tax AS lag0, lag(l_tax, 3) OVER w AS lag1, (i0 + 5) % (SELECT count(*) FROM lineitem) AS turned FROM {LONG} WINDOW w AS (ORDER BY i0) QUALIFY i0 >= 3")
def long_lags(spark: SparkSession, d: str) -> DataFrame:
    lagged = sequences.lags(_long(spark, d, "l_tax"), [], ["i0"], "l_tax", 3, 2).select("i0", "lag0", "lag1")
    return sequences.rotate(_long(spark, d, "l_tax").select("i0", F.col("i0").alias("turned")), [], "turned", 5).join(lagged, "i0").select("i0", "lag0", "lag1", "turned")


@query(f"""WITH m AS (SELECT i0, l_returnflag, CASE WHEN i0 = 0 OR l_returnflag = lag(l_returnflag) OVER (ORDER BY i0) THEN 0 ELSE 1 END AS new FROM {LONG}), n AS (SELECT *, sum(new) OVER (ORDER BY i0) AS run FROM m)
    SELECT CAST(run AS BIGINT) AS run, count(*) AS len, any_value(l_returnflag) AS value FROM n GROUP BY 1""")
def long_runs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rle(_long(spark, d, "l_returnflag"), [], ["i0"], "l_returnflag")


@query(f"SELECT i0, l_returnflag AS value FROM {LONG}")
def long_runs_back(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rld(sequences.rle(_long(spark, d, "l_returnflag"), [], ["i0"], "l_returnflag"), []).select("i0", "value")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS rank FROM customer")
def qsorti_all(spark: SparkSession, d: str) -> DataFrame:
    return sequences.qsorti(read(spark, d, "customer"), [], "c_acctbal", ["c_custkey"]).select("c_custkey", "rank")


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS mid FROM lineitem GROUP BY 1")
def oddmed_flags(spark: SparkSession, d: str) -> DataFrame:
    return sequences.oddpctover(read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5, "mid", median=True)


# vectors -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_size, p_partkey) - 1 AS rank, row_number() OVER (PARTITION BY p_type ORDER BY p_brand, p_size, p_partkey) - 1 AS within FROM part")
def qsortvec_parts(spark: SparkSession, d: str) -> DataFrame:
    ranked = sequences.qsortveci(read(spark, d, "part"), [], ["p_brand", "p_size"], ["p_partkey"])
    return sequences.qsortveci(ranked, ["p_type"], ["p_brand", "p_size"], ["p_partkey"], "within").select("p_partkey", "rank", "within")


@query(f"""WITH m AS (SELECT *, CASE WHEN i0 = 0 OR (l_returnflag = lag(l_returnflag) OVER w AND l_linestatus = lag(l_linestatus) OVER w) THEN 0 ELSE 1 END AS new FROM {ITEMS} WINDOW w AS (PARTITION BY l_orderkey ORDER BY i0)), n AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY i0) AS run FROM m)
    SELECT l_orderkey, CAST(run AS BIGINT) AS run, count(*) AS len, any_value(l_returnflag) AS l_returnflag, any_value(l_linestatus) AS l_linestatus FROM n GROUP BY 1, 2""")
def rlevec_flags(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rlevec(items(spark, d, "l_returnflag", "l_linestatus"), ["l_orderkey"], ["i0"], ["l_returnflag", "l_linestatus"])


@query(f"SELECT l_orderkey, i0, l_returnflag, l_linestatus FROM {ITEMS}")
def rldvec_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = ["l_returnflag", "l_linestatus"]
    return sequences.rldvec(sequences.rlevec(items(spark, d, *flags), ["l_orderkey"], ["i0"], flags), ["l_orderkey"], flags)


@query("""WITH k AS (SELECT DISTINCT l_linenumber AS a, CAST(l_quantity AS INT) AS b FROM lineitem), n AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS at FROM k)
    SELECT p_partkey, (SELECT count(*) FROM n WHERE (n.a, n.b) < (p.a, p.b)) AS found FROM (SELECT p_partkey, CAST(p_partkey % 9 AS INT) AS a, p_size AS b FROM part) p""")
def vsearchvec_parts(spark: SparkSession, d: str) -> DataFrame:
    k = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b"))
    p = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 9).cast("int").alias("a"), F.col("p_size").alias("b"))
    return search.vsearchvec(k, ["a", "b"], p, ["a", "b"]).select("p_partkey", "found")


@query(f"SELECT l_orderkey, i0, round(l_quantity - coalesce(lead(l_quantity) OVER w, 0), 2) AS back, round(l_quantity - coalesce(lag(l_quantity) OVER w, 0), 2) AS forth FROM {ITEMS} WINDOW w AS (PARTITION BY l_orderkey ORDER BY i0)")
def partial_quantities(spark: SparkSession, d: str) -> DataFrame:
    x = items(spark, d, "l_quantity")
    both = sequences.partial(sequences.partial(x, ["l_orderkey"], ["i0"], "l_quantity", "b", "b"), ["l_orderkey"], ["i0"], "l_quantity", "f", "f")
    return both.select("l_orderkey", "i0", r(F.col("b"), 2).alias("back"), r(F.col("f"), 2).alias("forth"))


@query("""SELECT s_nationkey, n, round(n * 0.75e0 ** 3 + 1, 6) AS value, round(3 * n * 0.75e0 ** 2, 6) AS slope, round(n * 81 / 4e0 + 3, 6) AS integral, round(2 * 0.75e0 + n, 6) AS line FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)""")
def cubic_knots(spark: SparkSession, d: str) -> DataFrame:
    """Knots of a cubic and of a line for each nation, which the spline and the monotone interpolant give back."""
    groups = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    knots = groups.withColumn("x", F.explode(F.array(*[F.lit(a) for a in (0.0, 0.5, 1.25, 2.0, 3.0)])))
    knots = knots.select("s_nationkey", "x", (F.col("n") * F.col("x") ** 3 + 1).alias("y"), (2 * F.col("x") + F.col("n")).alias("z"))
    probes = groups.withColumn("v", F.lit(0.75))
    got = search.cubic_interpolate(knots, ["s_nationkey"], "x", "y", probes, "v", "spline").select("s_nationkey", "n", r(F.col("value")).alias("value"), r(F.col("slope")).alias("slope"))
    line = search.cubic_interpolate(knots, ["s_nationkey"], "x", "z", probes, "v", "pchip").select("s_nationkey", r(F.col("value")).alias("line"))
    area = search.integrate(knots, ["s_nationkey"], "x", "y", 0.0, 3.0, "spline").select("s_nationkey", r(F.col("integral")).alias("integral"))
    return got.join(area, "s_nationkey").join(line, "s_nationkey")


# transforms of cells -------------------------------------------------------------------------------

_SIGNAL = "(SELECT l_partkey % 48 AS i, sum(l_quantity) AS re, CAST(count(*) AS DOUBLE) AS im FROM lineitem GROUP BY 1)"


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 48).alias("i")).agg(F.sum("l_quantity").alias("re"), F.count("*").cast("double").alias("im"))


def _rounded(*names: str) -> list[Column]:
    """Four digits, and no negative zero."""
    return [(r(F.col(n), 4) + 0.0).alias(n) for n in names]


@query(f"""SELECT k AS i, round(sum(re * cos(2 * pi() * k * i / 48) + im * sin(2 * pi() * k * i / 48)), 4) + 0e0 AS re, round(sum(im * cos(2 * pi() * k * i / 48) - re * sin(2 * pi() * k * i / 48)), 4) + 0e0 AS im FROM {_SIGNAL}, range(48) t(k) GROUP BY 1""")
def fft_long(spark: SparkSession, d: str) -> DataFrame:
    return signal.fft_cells(_signal(spark, d), [], "i", 6, 8).select("i", *_rounded("re", "im"))


@query(f"SELECT i, round(re, 4) + 0e0 AS re, round(im, 4) + 0e0 AS im FROM {_SIGNAL}")
def ifft_long(spark: SparkSession, d: str) -> DataFrame:
    back = signal.fft_cells(signal.fft_cells(_signal(spark, d), [], "i", 6, 8), [], "i", 4, 12, inverse=True)
    return back.select("i", *_rounded("re", "im"))


_PLANE = "(SELECT l_linenumber - 1 AS i, l_suppkey % 5 AS j, sum(l_quantity) AS re FROM lineitem GROUP BY 1, 2)"


@query(f"""SELECT a AS i, b AS j, round(sum(re * cos(2 * pi() * (a * i / 7e0 + b * j / 5e0))), 4) + 0e0 AS re, round(-sum(re * sin(2 * pi() * (a * i / 7e0 + b * j / 5e0))), 4) + 0e0 AS im FROM {_PLANE}, range(7) t(a), range(5) u(b) GROUP BY 1, 2""")
def fftnd_plane(spark: SparkSession, d: str) -> DataFrame:
    plane = read(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("i"), (F.col("l_suppkey") % 5).alias("j")).agg(F.sum("l_quantity").alias("re")).withColumn("im", F.lit(0.0))
    return signal.fftnd(plane, [], ["i", "j"]).select("i", "j", *_rounded("re", "im"))


_CUBE = "(SELECT l_linenumber - 1 AS i, l_suppkey % 5 AS j, l_partkey % 4 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)"


@query(f"""SELECT CAST((i + a + 7) % 7 AS BIGINT) AS i, (j + b + 5) % 5 AS j, (k + c + 4) % 4 AS k, round(sum(v * w), 4) AS v FROM {_CUBE}, (VALUES (0, 0, 0, 0.5e0), (1, 0, 0, 0.2e0), (0, -1, 1, 0.3e0)) t(a, b, c, w) GROUP BY 1, 2, 3""")
def convolve_cube(spark: SparkSession, d: str) -> DataFrame:
    cube = read(spark, d, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("i"), (F.col("l_suppkey") % 5).alias("j"), (F.col("l_partkey") % 4).alias("k")).agg(F.sum("l_quantity").alias("v"))
    return signal.convolve_nd(cube, [], ["i", "j", "k"], [7, 5, 4], {(0, 0, 0): 0.5, (1, 0, 0): 0.2, (0, -1, 1): 0.3}).select("i", "j", "k", r(F.col("v"), 4).alias("v"))


@query(f"WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT (i0 + 100 - 32) % 100 AS i, (i1 + n + 10 - n // 2) % (n + 10) AS j, v FROM {CELLS}, n")
def kernctr_cells(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "embeddings").count()
    return signal.kernctr(_cells(spark, d).withColumnsRenamed({"i0": "i", "i1": "j"}), ["i", "j"], [64, n], [100, n + 10])

"""Queries over elementwise functions, missing values, complex numbers, special functions and whole-array folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import aggregates as A
from cellgrid.functions import elementwise as E
from cellgrid.functions import special as S
from cellgrid.operators import linalg, sequences, transforms
from cellgrid.plans.registry import ITEMS, items, query, r, read, vectors

KEY = ["l_orderkey", "i0"]


@query(f"""SELECT l_orderkey, i0, round(l_quantity + l_tax, 6) AS plus, round(l_quantity - l_tax, 6) AS minus, round(l_quantity * l_tax, 6) AS times, CAST(l_tax > l_discount AS INT) AS gt, CAST(l_tax < l_discount AS INT) AS lt,
    CAST(l_tax <= l_discount AS INT) AS le, CAST(l_tax = l_discount AS INT) AS eq, CAST(l_tax <> l_discount AS INT) AS ne, CAST(l_tax = 0 AS INT) AS unset, round(pow(1 + l_tax, l_quantity / 10), 6) AS power, round(sqrt(l_quantity), 6) AS root,
    round(exp(l_tax), 6) AS e, round(log10(l_quantity), 6) AS lg10, round(l_tax * l_tax, 8) AS square, least(l_tax, 0.05) AS high, greatest(l_tax, 0.03) AS low, CAST(abs(l_tax - l_discount) <= 0.015 AS INT) AS near FROM {ITEMS}""")
def arithmetic_cells(spark: SparkSession, d: str) -> DataFrame:
    q, t, c = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    return items(spark, d, "l_quantity", "l_tax", "l_discount").select(
        *KEY, r(E.plus(q, t)).alias("plus"), r(E.minus(q, t)).alias("minus"), r(E.mult(q, t)).alias("times"), E.gt(t, c).alias("gt"), E.lt(t, c).alias("lt"), E.le(t, c).alias("le"), E.eq(t, c).alias("eq"), E.ne(t, c).alias("ne"),
        E.logical_not(t).alias("unset"), r(E.power(1 + t, q / 10)).alias("power"), r(E.sqrt(q)).alias("root"), r(E.exp(t)).alias("e"), r(E.log10(q)).alias("lg10"), r(E.abs2(t), 8).alias("square"), E.hclip(t, 0.05).alias("high"), E.lclip(t, 0.03).alias("low"), E.approx(t, c, 0.015).alias("near"),
    )


@query("""SELECT p_partkey, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos, round(tan(x), 6) AS tan, round(asin(x), 6) AS asin, round(acos(x), 6) AS acos, round(atan(x), 6) AS atan, round(sinh(x), 6) AS sinh, round(cosh(x), 6) AS cosh, round(tanh(x), 6) AS tanh,
    round(asinh(x), 6) AS asinh, round(acosh(1 + x), 6) AS acosh, round(atanh(x), 6) AS atanh, round(pow(1 + x, 1.5), 6) AS pow FROM (SELECT p_partkey, (p_size + 0.25) / 64 AS x FROM part)""")
def trigonometry(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("p_size") + 0.25) / 64
    names = ["sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh"]
    return read(spark, d, "part").select("p_partkey", *[r(E.DIRECT[n](x)).alias(n) for n in names], r(E.DIRECT["acosh"](1 + x)).alias("acosh"), r(E.DIRECT["pow"](1 + x, F.lit(1.5))).alias("pow"))


# double factorials and factorials by the gamma function: series that share nothing with the functions' own ways
_TERMS = "unnest(range(70)) AS k"
_J = "sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + {n}) * ln(x / 2) - lgamma(k + 1) - lgamma(k + 1 + {n})))"


@query(f"""WITH p AS (SELECT p_size, (p_size + 0.5) / 12 AS x FROM part GROUP BY 1), t AS (SELECT p_size, x, {_TERMS} FROM p),
    h AS (SELECT p_size, x, k, coalesce((SELECT sum(1e0 / j) FROM range(1, 71) u(j) WHERE j <= k), 0) AS hk FROM t),
    s AS (SELECT p_size, x, 2 / sqrt(pi()) * exp(-x * x) * sum(exp((2 * k + 1) * ln(x) + k * ln(2) - lgamma(2 * k + 3) + (k + 1) * ln(2) + lgamma(k + 2))) AS erf, {_J.format(n=0)} AS j0, {_J.format(n=1)} AS j1, {_J.format(n=3)} AS j3,
        2 / pi() * (ln(x / 2) + 0.57721566490153286) * {_J.format(n=0)} - 2 / pi() * sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * hk * exp(2 * k * ln(x / 2) - 2 * lgamma(k + 1))) AS y0 FROM h GROUP BY 1, 2)
    SELECT p_partkey, round(erf, 6) AS erf, round(1 - erf, 6) AS erfc, round(j0, 6) AS j0, round(j1, 6) AS j1, round(j3, 6) AS j3, round(y0, 6) AS y0, round(x * (j1 * y0 - 2 / (pi() * x)), 5) AS y1j0, round(lgamma(x), 6) AS lgamma,
        round((p_size + 0.5) / 64, 9) AS quantile_back, round((p_size + 0.5) / 64, 9) AS erfi_back FROM part JOIN s USING (p_size)""")
def special_functions(spark: SparkSession, d: str) -> DataFrame:
    x, u = (F.col("p_size") + 0.5) / 12, (F.col("p_size") + 0.5) / 64
    # Y1 by the Wronskian of the two kinds, times J0, as J0 may be near 0
    return read(spark, d, "part").select("p_partkey", r(S.erf(x)).alias("erf"), r(S.erfc(x)).alias("erfc"), r(S.bessj0(x)).alias("j0"), r(S.bessj1(x)).alias("j1"), r(S.bessjn(x, 3)).alias("j3"), r(S.bessy0(x)).alias("y0"), r(x * S.bessy1(x) * S.bessj0(x), 5).alias("y1j0"),
        r(S.lgamma(x)["value"]).alias("lgamma"), r(S.erfc(-S.ndtri(u) / 2**0.5) / 2, 9).alias("quantile_back"), r(S.erf(S.erfi(u)), 9).alias("erfi_back"))


@query("""WITH v AS (SELECT l_orderkey, i0, l_tax, CASE WHEN l_discount = 0.05 THEN 'nan'::DOUBLE WHEN l_discount = 0.06 THEN 'inf'::DOUBLE WHEN l_discount = 0.07 THEN NULL ELSE l_discount END AS v FROM """ + ITEMS + """)
    SELECT l_orderkey, i0, CAST(v IS NOT NULL AS INT) AS good, CAST(coalesce(isnan(v), false) AS INT) AS nan, CAST(coalesce(isfinite(v), false) AS INT) AS finite, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS cleaned, CASE WHEN isnan(v) THEN NULL WHEN isinf(v) THEN 9 ELSE v END AS no_nan,
    CAST(v IS NULL OR isinf(v) AS INT) AS no_inf, CAST(coalesce(isnan(v), true) AS INT) AS back_nan, CASE WHEN isfinite(v) THEN v ELSE l_tax END AS masked FROM v""")
def missing_marks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("l_discount")
    x = items(spark, d, "l_tax", "l_discount").withColumn("v", F.when(c == 0.05, float("nan")).when(c == 0.06, E.INF).when(c == 0.07, None).otherwise(c))
    no_nan = E.setnantobad("v")
    return x.select(*KEY, E.isgood("v").alias("good"), F.coalesce(E.DIRECT["isnan"]("v"), F.lit(False)).cast("int").alias("nan"), E.isfinite("v").alias("finite"), E.setinftobad(no_nan).alias("cleaned"), F.when(no_nan == E.INF, 9.0).otherwise(no_nan).alias("no_nan"),
        E.isbad(E.setinftobad("v")).alias("no_inf"), F.isnan(E.setbadtonan("v")).cast("int").alias("back_nan"), E.badmask("v", "l_tax").alias("masked"))


@query("SELECT CAST(count_if(l_discount = 0.05) AS BIGINT) AS nbad, CAST(count_if(l_discount <> 0.05) AS BIGINT) AS ngood, round(quantile_cont(l_tax, 0.9), 6) AS pct, quantile_disc(l_quantity, 0.5) AS oddmed, round(sum(l_tax * l_quantity) / sum(l_tax), 6) AS wmean, round(sum(l_quantity), 2) AS total, max(l_tax) AS most, count(DISTINCT l_suppkey) AS folded FROM lineitem")
def whole_array_more(spark: SparkSession, d: str) -> DataFrame:
    x = read(spark, d, "lineitem")
    marked = E.setvaltobad("l_discount", 0.05)
    sums = x.agg(A.nbadover(marked).alias("nbad"), A.ngoodover(marked).alias("ngood"), r(A.wtstat("l_quantity", F.col("l_tax"), F.lit(0.0))).alias("wmean"), r(A.reduce("+", "l_quantity"), 2).alias("total"), A.reduce("max", "l_tax").alias("most"), A.reduce(F.count_distinct, "l_suppkey").alias("folded"))
    pct = sequences.pctover(x, [], "l_tax", {"pct": 0.9}).select(r(F.col("pct")).alias("pct"))
    odd = sequences.oddpctover(x, [], "l_quantity", 0.5, "oddmed", median=True)
    return sums.crossJoin(F.broadcast(pct)).crossJoin(F.broadcast(odd))  # one row each


@query("""WITH z AS (SELECT o_orderkey, o_totalprice / 1e5 AS re, (o_custkey - 500) / 300 AS im FROM orders), m AS (SELECT *, sqrt(re * re + im * im) AS r FROM z), s AS (SELECT *, sqrt((r + re) / 2) AS a, sqrt((r - re) / 2) * CASE WHEN im < 0 THEN -1 ELSE 1 END AS b FROM m)
    SELECT o_orderkey, round(re, 8) AS re, round(-im, 6) + 0e0 AS conj_im, round(a, 6) AS root_re, round(b, 6) AS root_im, round(CASE WHEN b < 0 THEN -a ELSE a END, 6) AS up_re, round(abs(b), 6) AS up_im, round(ln(r), 6) AS log_re, round(atan2(im, re), 6) AS log_im, round(2 * re, 8) AS twice, round(re, 8) AS c_re, round(im, 6) AS i_im FROM s""")
def complex_functions(spark: SparkSession, d: str) -> DataFrame:
    z = E.czip(F.col("o_totalprice") / 1e5, (F.col("o_custkey") - 500) / 300)
    s, u, g, twice = E.csqrt(z), E.csqrt_up(z), E.clog(z), E.cplus(z, E.conj(z))
    return read(spark, d, "orders").select("o_orderkey", r(E.re(z), 8).alias("re"), (r(E.im(E.conj(z))) + 0.0).alias("conj_im"), r(E.re(s)).alias("root_re"), r(E.im(s)).alias("root_im"), r(E.re(u)).alias("up_re"), r(E.im(u)).alias("up_im"), r(E.re(g)).alias("log_re"), r(E.im(g)).alias("log_im"), r(E.re(twice), 8).alias("twice"),
        r(E.re(E.r2c(E.re(z))), 8).alias("c_re"), r(E.im(E.i2c(E.im(z)))).alias("i_im"))


@query("SELECT p_partkey, round(-(a + b), 6) AS c1, round(a * b, 6) AS c0, greatest(0, least(255, CAST(floor((p_retailprice - 900) * 255 / 1200 + 0.5) AS INT))) AS stretched, CAST(p_size AS INT) AS same FROM (SELECT *, p_size / 10 AS a, p_retailprice / 500 AS b FROM part)")
def polynomial_of_roots(spark: SparkSession, d: str) -> DataFrame:
    c = E.polyfromroots(F.array(F.col("p_size") / 10, F.col("p_retailprice") / 500))
    return read(spark, d, "part").select("p_partkey", r(c[1]).alias("c1"), r(c[2]).alias("c0"), E.clip(E.bytescl("p_retailprice", 900.0, 2100.0), 0, 255).alias("stretched"), E.bytescl("p_size", 1, 50).alias("same"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), h AS (SELECT vec_id, list_transform(e[1:3], lambda x: round(x)) AS a, list_transform(e[4:6], lambda x: round(x)) AS b, e FROM v)
    SELECT vec_id, CASE WHEN a < b THEN -1 WHEN a = b THEN 0 ELSE 1 END AS cmp, CAST(a = b AS INT) AS eqv, round(e[1] * e[5] * e[9] + e[2] * e[6] * e[10] + e[3] * e[7] * e[11] + e[4] * e[8] * e[12], 6) AS weighted FROM h""")
def vector_compare(spark: SparkSession, d: str) -> DataFrame:
    whole = lambda at: F.transform(F.slice("e", at, 3), lambda x: F.round(x) + 0.0)
    return vectors(spark, d).select("vec_id", E.cmpvec(whole(1), whole(4)).alias("cmp"), E.eqvec(whole(1), whole(4)).alias("eqv"), r(E.innerwt(F.slice("e", 1, 4), F.slice("e", 5, 4), F.slice("e", 9, 4))).alias("weighted"))


@query("""WITH m AS (SELECT vec_id, e[1] AS a, e[2] AS b, e[3] AS c, e[4] AS d, e[5] AS x, e[6] AS y FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)), n AS (SELECT *, a * d - b * c AS det, a * a + b * b + c * c + d * d AS q, sqrt((a - d) * (a - d) / 4 + b * b) AS h FROM m)
    SELECT vec_id, round(det, 6) AS det, round(d / det * abs(det), 5) AS inv00, round((d * x - b * y) / det * abs(det), 5) + 0e0 AS x0, round((a + d) / 2 - h, 5) AS low, round((a + d) / 2 + h, 5) AS high, round(sqrt((q + sqrt(greatest(0, q * q - 4 * det * det))) / 2), 5) AS s0,
    round(CASE WHEN b * b >= 4 * c THEN (-b - sqrt(b * b - 4 * c)) / 2 ELSE -b / 2 END, 5) AS root, round(CASE WHEN abs(a) >= abs(c) THEN a ELSE c END, 6) AS pivot, round(x * (a * x + b * y) + y * (c * x + d * y), 6) + 0e0 AS form, round(q, 6) AS squares FROM n""")
def small_matrices(spark: SparkSession, d: str) -> DataFrame:
    e = lambda k: F.col("e")[k]
    m, sym = F.array(F.array(e(0), e(1)), F.array(e(2), e(3))), F.array(F.array(e(0), e(1)), F.array(e(1), e(3)))
    size = F.abs(linalg.det(m))
    return vectors(spark, d).select("vec_id", r(linalg.det(m)).alias("det"), r(linalg.inv(m)[0][0] * size, 5).alias("inv00"), (r(linalg.solve(m, F.array(e(4), e(5)))[0] * size, 5) + 0.0).alias("x0"), r(linalg.eigens_sym(sym)["values"][0], 5).alias("low"), r(linalg.eigens_sym(sym)["values"][1], 5).alias("high"),
        r(linalg.svd(m)["s"][0], 5).alias("s0"), r(S.polyroots(F.array(F.lit(1.0), e(1), e(2)))[0]["re"], 5).alias("root"),
        r(linalg.lu_decomp(m)["lu"][0][0]).alias("pivot"), (r(E.inner2(F.array(e(4), e(5)), m, F.array(e(4), e(5)))) + 0.0).alias("form"), r(E.inner2d(m, m)).alias("squares"))


@query("""WITH c AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT count(DISTINCT k) AS n, round(sum(v * v), 4) AS energy, round(sum(v * v), 4) AS kept FROM c""")
def svd_tall_energy(spark: SparkSession, d: str) -> DataFrame:
    """Squares of a long matrix's singular values add up to those of its cells, and so do those of its turned rows."""
    values, turned = linalg.svd_tall(vectors(spark, d), "e", "u")
    kept = turned.select(F.explode(F.arrays_zip("u", F.lit(values).alias("s"))).alias("x")).agg(r(F.sum((F.col("x.u") * F.col("x.s")) ** 2), 4).alias("kept"))
    return kept.select(F.lit(len(values)).cast("long").alias("n"), r(F.lit(sum(x * x for x in values)), 4).alias("energy"), "kept")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope FROM lineitem")
def least_squares(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.array(F.lit(1.0), "l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    a, b = linalg.solve_tall(rows, "x", "y")
    return spark.range(1).select(F.round(F.lit(a), 4).alias("intercept"), F.round(F.lit(b), 6).alias("slope"))


_LONLAT = "(SELECT c_custkey, radians(c_nationkey * 5 - 60) AS x, radians(c_custkey % 140 - 70 + 0.25) AS y FROM customer)"


@query(f"""SELECT c_custkey, round(x * cos(y), 6) AS sinusoidal, round(sin(y), 6) AS sin_lat, round(cos(y) * sin(x), 6) AS orthographic, round(2 * cos(y) * sin(x) / (1 + cos(y) * cos(x)), 6) AS stereographic, round(sqrt(2 / (1 + cos(y) * cos(x))) * sin(y), 6) AS equal_area,
    round(x, 6) AS back_x, round(y, 6) AS back_y, round(cos(y) * cos(x), 6) AS unit, round(1 + 2 * (x * cos(radians(30)) - y * sin(radians(30))), 5) AS turned, round(8 * x + 7, 5) AS thrice FROM {_LONLAT}""")
def projections(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.radians(F.col("c_nationkey") * 5 - 60), F.radians(F.col("c_custkey") % 140 - 70 + 0.25)
    t = transforms
    there = t.t_albers(0.3, 0.8)
    back = there.invert(*there.apply(x, y))
    turn = t.t_linear(rot=30, post=[1, 0], scale=2.0)
    twice = t.t_linear(scale=2.0, post=[1, 0]) ** 3
    return read(spark, d, "customer").select("c_custkey", r(t.t_sinusoidal().apply(x, y)[0]).alias("sinusoidal"), r(t.t_sin_lat().apply(x, y)[1]).alias("sin_lat"), r(t.t_orthographic().apply(x, y)[0]).alias("orthographic"), r(t.t_stereographic().apply(x, y)[0]).alias("stereographic"), r(t.t_az_eqa().apply(x, y)[1]).alias("equal_area"),
        r(back[0]).alias("back_x"), r(back[1]).alias("back_y"), r(t.t_unit_sphere().apply(x, y)[0]).alias("unit"), r(turn.apply(x, y)[0], 5).alias("turned"), r(twice.apply(x, y)[0], 5).alias("thrice"))


_THERE_AND_BACK = ["t_radial", "t_unit_sphere", "t_carree", "t_gnomonic", "t_az_eqd", "t_hammer"]


@query(f"SELECT c_custkey, {', '.join(f'round(x, 6) AS {n}' for n in _THERE_AND_BACK)}, round(x, 6) AS conic, round(x, 6) AS lambert, round(x, 6) AS turned, round(x, 6) AS warped, round(pi() / 180 * x, 6) AS degree, round(2 * (x * 180 / pi() + 1 - 3) + 10, 6) AS fits FROM {_LONLAT}")
def projections_and_back(spark: SparkSession, d: str) -> DataFrame:
    """Transforms with their inverse behind them, and a linear one from the keys of an image's header."""
    x, y = F.radians(F.col("c_nationkey") * 5 - 60), F.radians(F.col("c_custkey") % 140 - 70 + 0.25)
    t = transforms
    around = {n: getattr(t, n)() for n in _THERE_AND_BACK} | {"conic": t.t_conic(0.3, 0.9), "lambert": t.t_lambert(0.3, 0.9), "turned": t.t_rot_sphere(0.4, 0.2), "warped": t.t_quadratic(0.3)}
    back = [r((~a).apply(*a.apply(x / 2, y / 2))[0] * 2).alias(n) for n, a in around.items()]
    header = t.t_fits({"CRPIX1": 3, "CRVAL1": 10, "CDELT1": 2, "CRPIX2": 1, "CRVAL2": 0, "CDELT2": 1})
    return read(spark, d, "customer").select("c_custkey", *back, r(E.DEG2RAD * x).alias("degree"), r(header.apply(E.RAD2DEG * x, y)[0]).alias("fits"))

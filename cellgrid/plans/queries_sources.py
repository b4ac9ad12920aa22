"""Queries that write a table in a format and read it back, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import rice
from cellgrid.plans.registry import query, r, read
from cellgrid.plans.shared import new_path
from cellgrid.sources import binary, spans, text

_SUPPLIERS = "SELECT s_suppkey, s_acctbal, CAST(s_nationkey AS INT) AS s_nationkey FROM supplier"


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")


@query(_SUPPLIERS)
def text_columns(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "wcols")
    text.wcols(_suppliers(spark, d), ["s_suppkey", "s_acctbal", "s_nationkey"], path, sep=" ")
    return text.rcols(spark, path, ["s_suppkey", "s_acctbal", "s_nationkey"], types=["bigint", "double", "int"])


@query("SELECT s_suppkey, coalesce(CASE WHEN s_nationkey % 3 > 0 THEN s_acctbal END, -1) AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 7")
def text_columns_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated lines with empty fields, of which those with a pattern are left out."""
    path = new_path(spark, "wcols")
    gaps = _suppliers(spark, d).withColumn("s_acctbal", F.when(F.col("s_nationkey") % 3 > 0, F.col("s_acctbal")))
    text.swcols(gaps, ["s_suppkey", "s_acctbal"], sep=",").write.text(path)
    return text.rcols(spark, path, ["s_suppkey", "s_acctbal"], sep=",", exclude="^[0-9]*7,", types=["bigint", "double"], undef=-1.0)


@query("SELECT n - 1 - (k - 3) // 2 AS nth, key, name FROM (SELECT *, max((k - 3) // 2) OVER () + 1 AS n FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS total, c_custkey AS key, c_name AS name FROM customer) WHERE k >= 3 AND k < total - 5 AND (k - 3) % 2 = 0)")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every second line between the fourth and the fifth but one, turned; the first line names the columns."""
    path = new_path(spark, "lines")
    customers = read(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey")
    head = spark.range(1).select(F.lit("key name").alias("line"), F.lit(-1).cast("long").alias("k"))
    body = text.swcols(customers.withColumn("name", F.translate("c_name", " ", "_")), ["c_custkey", "name"])
    both = head.unionByName(body.withColumn("k", F.split("line", " ")[0].cast("long")))
    both.orderBy("k").select("line").coalesce(1).write.text(path)
    names = text.column_ids(spark, path)
    return text.rcols(spark, path, names, types=["bigint", "string"], lines="-6:3:2", colids=True)


@query("SELECT CAST(s_suppkey AS DOUBLE) AS key, CAST(s_nationkey AS DOUBLE) AS nation FROM supplier WHERE s_nationkey >= 10")
def text_grep(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "lines")
    text.wcols(_suppliers(spark, d), ["s_suppkey", "s_nationkey"], path, fmt="key <%d> of nation=%d;")
    return text.rgrep(spark, path, r"<(\d+)>.*=(\d\d);", ["key", "nation"])


@query("SELECT CAST(n_nationkey AS DOUBLE) AS nums, 0 AS ierr FROM nation UNION ALL SELECT CAST(0 AS DOUBLE), 1 FROM nation")
def text_numbers(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "numbers")
    text.wcols(read(spark, d, "nation").select("n_nationkey", F.lit("none").alias("word")), ["n_nationkey", "word"], path)
    return text.rasc(spark, path)


@query("SELECT CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b, CAST(0 AS BIGINT) AS file FROM nation UNION ALL SELECT CAST(r_regionkey AS DOUBLE), CAST(0 AS DOUBLE), 1 FROM region")
def text_cube(spark: SparkSession, d: str) -> DataFrame:
    paths = [new_path(spark, "layer") for _ in range(2)]
    text.wcols(read(spark, d, "nation"), ["n_nationkey", "n_regionkey"], paths[0])
    text.wcols(read(spark, d, "region").withColumn("zero", F.lit(0)), ["r_regionkey", "zero"], paths[1])
    return text.rcube(spark, paths, ["a", "b"])


# packed arrays: a row of quantities for each return flag and line status --------------------------------

_PACKED = "(SELECT l_returnflag || l_linestatus AS name, list(n ORDER BY k) AS data FROM (SELECT l_returnflag, l_linestatus, k, CAST(count(*) FILTER (l_linenumber = k % 4 + 1 AND l_suppkey % 3 = k // 4) AS DOUBLE) AS n FROM lineitem, range(12) t(k) GROUP BY 1, 2, 3) GROUP BY 1)"


def _packed(spark: SparkSession, d: str) -> DataFrame:
    k = lambda n: (F.col("l_linenumber") == n % 4 + 1) & (F.col("l_suppkey") % 3 == n // 4)
    sums = read(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("name"))
    return sums.agg(F.array(*[F.count_if(k(n)).cast("double") for n in range(12)]).alias("data")).withColumn("shape", F.array(F.lit(4), F.lit(3)))


def _cells(read_back: DataFrame) -> DataFrame:
    named = read_back.withColumn("name", F.regexp_extract("file", r"([^/.]+)[.][a-z]+$", 1)).select("name", "data", "shape")
    return binary.cells(named).select("name", F.col("i")[0].alias("i"), F.col("i")[1].alias("j"), "v")


_CELLS = f"SELECT name, k % 4 AS i, k // 4 AS j, v FROM (SELECT name, unnest(data) AS v, generate_subscripts(data, 1) - 1 AS k FROM {_PACKED})"


@query(_CELLS)
def raw_arrays(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "raw")
    binary.save(_packed(spark, d).select(F.concat("name", F.lit(".raw")).alias("name"), binary.raw_bytes(F.col("data"), "long").alias("content")), folder)
    return _cells(binary.readraw(spark, folder, "long", [4, 3]))


@query(_CELLS)
def raw_arrays_swapped(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "raw")
    binary.save(_packed(spark, d).select(F.concat("name", F.lit(".raw")).alias("name"), binary.raw_bytes(F.col("data"), "double", swap=True).alias("content")), folder)
    return _cells(binary.readraw(spark, folder, "double", [4, 3], swap=True))


@query(f"SELECT name, data[1] AS first, data[12] AS last, data[1] + 1 AS glued FROM {_PACKED}")
def flex_glued(spark: SparkSession, d: str) -> DataFrame:
    """A chunk written behind the one that the files hold already."""
    folder, into = new_path(spark, "flex"), new_path(spark, "glued")
    x = _packed(spark, d).withColumn("file", F.concat("name", F.lit(".flex")))
    binary.save(x.withColumn("bytes", binary.raw_bytes(F.col("data"), "long")), folder, "file", "bytes")
    binary.glue(spark, folder, x.select("file", binary.raw_bytes(F.array(F.col("data")[0] + 1), "float").alias("bytes")), into, "file", "bytes")
    chunks = [{"type": "long", "dims": [4, 3]}, {"type": "float", "dims": [1]}]
    got = binary.readflex(spark, into, chunks).groupBy(F.regexp_extract("file", r"([^/.]+)[.]flex$", 1).alias("name"))
    whole, extra = F.col("dtype") == "long", F.col("dtype") == "float"
    return got.agg(F.max(F.when(whole, F.col("data")[0])).alias("first"), F.max(F.when(whole, F.col("data")[11])).alias("last"), F.max(F.when(extra, F.col("data")[0])).alias("glued"))


@query(f"SELECT name, part, v FROM (SELECT name, 0 AS part, data[1] AS v FROM {_PACKED} UNION ALL SELECT name, 1, data[2] + data[3] / 4 FROM {_PACKED})")
def flex_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Two chunks of different types in each file, told by a header that is written and read as well; counts in 64 bits, as those
    of a large table are beyond 16."""
    folder = new_path(spark, "flex")
    parts = binary.raw_bytes(F.slice("data", 1, 2), "longlong"), binary.raw_bytes(F.array(F.col("data")[1] + F.col("data")[2] / 4), "double")
    binary.save(_packed(spark, d).select(F.concat("name", F.lit(".flex")).alias("name"), F.concat(*parts).alias("content")), folder)
    head = binary.write_flexhdr([{"type": "longlong", "dims": [2]}, {"type": "double", "dims": [1]}])
    got = binary.readflex(spark, folder, binary.parse_flexhdr(head))
    return got.select(F.regexp_extract("file", r"([^/.]+)[.]flex$", 1).alias("name"), F.when(F.col("dtype") == "longlong", 0).otherwise(1).alias("part"), F.col("data")[0].alias("v"))


@query(_CELLS)
def fits_images(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "fits")
    binary.save(_packed(spark, d).select(F.concat("name", F.lit(".fits")).alias("name"), binary.fits_of(F.col("data"), F.col("shape"), "i4").alias("content")), folder)
    return _cells(binary.rfits(spark, folder))


@query(f"SELECT name, 'FITS' AS format, '32' AS bitpix, '4' AS width, 'counts' AS unit FROM {_PACKED}")
def fits_headers(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "fits")
    files = _packed(spark, d).select(F.concat("name", F.lit(".fits")).alias("name"), binary.fits_of(F.col("data"), F.col("shape"), "i4", {"bunit": "counts"}).alias("content"))
    binary.save(files, folder)
    kinds = files.select(F.regexp_extract("name", "^(.*)[.]", 1).alias("name"), binary.imageformat(F.col("content")).alias("format"))
    h = lambda k: F.col("header")[k]
    heads = binary.rfitshdr(spark, folder).select(F.regexp_extract("file", r"([^/.]+)[.]fits$", 1).alias("name"), h("BITPIX").alias("bitpix"), h("NAXIS1").alias("width"), h("BUNIT").alias("unit"))
    return kinds.join(heads, "name")


@query(f"SELECT name, i, j, least(v, 255) AS v FROM ({_CELLS})")
def pnm_images(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "pnm")
    grey = _packed(spark, d).withColumn("data", F.transform("data", lambda x: F.least(x, F.lit(255.0))))
    raw = F.col("name").startswith("A")
    content = F.when(raw, binary.pnm_of(F.col("data"), F.col("shape"))).otherwise(binary.pnm_of(F.col("data"), F.col("shape"), raw=False))
    binary.save(grey.select(F.concat("name", F.lit(".pgm")).alias("name"), content.alias("content")), folder)
    return _cells(binary.rpnm(spark, folder))


@query("SELECT CAST(n_nationkey AS BIGINT) AS face, c AS corner, CAST(CASE c WHEN 0 THEN n_nationkey WHEN 1 THEN n_regionkey ELSE 1 END AS DOUBLE) AS x, CAST(CASE c WHEN 2 THEN 0.5 ELSE c END AS DOUBLE) AS y, CAST(n_regionkey AS DOUBLE) AS z FROM nation, (VALUES (0), (1), (2)) t(c)")
def stl_mesh(spark: SparkSession, d: str) -> DataFrame:
    folder = new_path(spark, "stl")
    n, g = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    face = F.array(n, F.lit(0.0), g, g, F.lit(1.0), g, F.lit(1.0), F.lit(0.5), g)
    mesh = read(spark, d, "nation").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", face.alias("f")))), lambda x: x["f"])).alias("corners"))  # one small mesh
    binary.save(mesh.select(F.lit("nations.stl").alias("name"), binary.stl_of(F.col("corners")).alias("content")), folder)
    return spans.rstl(spark, folder).select("face", "corner", *[r(F.col(c), 4).alias(c) for c in "xyz"])


@query("SELECT count(DISTINCT (CASE c WHEN 0 THEN n_nationkey WHEN 1 THEN n_regionkey ELSE 1 END, c, n_regionkey)) AS vertices, CAST(75 AS BIGINT) AS corners FROM nation, (VALUES (0), (1), (2)) t(c)")
def stl_vertices(spark: SparkSession, d: str) -> DataFrame:
    vertices, index = binary.mesh_vertices(stl_mesh(spark, d).withColumn("file", F.lit("f")))
    return vertices.agg(F.count("*").alias("vertices")).crossJoin(index.agg(F.count("*").alias("corners")))  # one row each


# large files in ranges -------------------------------------------------------------------------------

# the vectors in thousandths, by 256 in an image of 64 columns
_PLATES = "(SELECT vec_id // 256 AS plate, row_number() OVER (PARTITION BY vec_id // 256 ORDER BY vec_id) - 1 AS j, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor(1000 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM embeddings)"


def _thousandths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(1000) * x.cast("double"))).alias("x"))


def _plates(spark: SparkSession, d: str) -> DataFrame:
    """At most 256 vectors each, as packed images."""
    plates = _thousandths(spark, d).groupBy(F.floor(F.col("vec_id") / 256).alias("plate"))
    rows = plates.agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("rows"))
    return rows.select("plate", F.flatten(F.col("rows.x")).alias("data"), F.array(F.lit(64), F.size("rows")).alias("shape"))


def _plate_cells(cells: DataFrame) -> DataFrame:
    plate = F.regexp_extract("file", r"([0-9]+)[.][a-z]+$", 1).cast("long")
    return cells.select(plate.alias("plate"), F.col("i")[0].alias("i"), F.col("i")[1].alias("j"), F.col("v").cast("long").alias("v"))


@query("""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor(1000 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS v FROM embeddings),
    d AS (SELECT vec_id, i // 32 AS b, coalesce(v - lag(v) OVER (PARTITION BY vec_id ORDER BY i), 0) AS d FROM x),
    f AS (SELECT vec_id, b, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS f FROM d),
    m AS (SELECT vec_id, b, sum(f) AS s, CAST(floor(greatest((sum(f) - 17) / 32, 0)) AS BIGINT) // 2 AS m FROM f GROUP BY 1, 2),
    k AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE length(bin(m)) END AS k FROM m),
    l AS (SELECT vec_id, b, 5 + CASE WHEN any_value(s) = 0 THEN 0 WHEN any_value(k) >= 25 THEN 1024 ELSE sum((f >> k) + 1 + k) END AS bits FROM f JOIN k USING (vec_id, b) GROUP BY 1, 2)
    SELECT vec_id, CAST(ceil((32 + sum(bits)) / 8) AS BIGINT) AS len, CAST(64 AS BIGINT) AS size, (SELECT sum(v * (i + 1)) FROM x WHERE x.vec_id = l.vec_id) AS read_back FROM l GROUP BY 1""")
def rice_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that each vector takes, and a sum over what is read back from them."""
    coded = _thousandths(spark, d).select("vec_id", rice.rice_compress(F.col("x")).alias("c"))
    back = coded.select("vec_id", "c.len", "c.size", rice.rice_expand(F.col("c.data"), F.col("c.size")).alias("x"))
    weighted = F.aggregate(F.transform("x", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return back.select("vec_id", "len", "size", weighted.alias("read_back"))


@query(f"SELECT plate, i, j, v FROM {_PLATES}")
def fits_tiled(spark: SparkSession, d: str) -> DataFrame:
    """Images stored as Rice-coded tiles, whose sides don't divide the image's."""
    folder = new_path(spark, "tiled")
    binary.save(_plates(spark, d).select(F.concat(F.col("plate").cast("string"), F.lit(".fits")).alias("name"), spans.tiled_fits_of(F.col("data"), F.col("shape"), "i4", [24, 10]).alias("content")), folder)
    return _plate_cells(spans.fits_tiled_cells(spark, folder))


@query(f"SELECT plate, i, j, v FROM {_PLATES}")
def fits_spans(spark: SparkSession, d: str) -> DataFrame:
    """Images read in spans of 1000 pixels."""
    folder = new_path(spark, "fits")
    binary.save(_plates(spark, d).select(F.concat(F.col("plate").cast("string"), F.lit(".fits")).alias("name"), binary.fits_of(F.col("data"), F.col("shape"), "i2").alias("content")), folder)
    return _plate_cells(spans.fits_cells(spark, folder, per=1000))


@query("SELECT l_orderkey, unit, v FROM (SELECT l_orderkey, 0 AS unit, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1 UNION ALL SELECT l_orderkey, 1, sum(l_quantity) / 2 FROM lineitem GROUP BY 1)")
def flex_spans(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of all orders in a range of keys in one file of two chunks, read in spans of 100 numbers."""
    folder = new_path(spark, "flex")
    orders = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("n"), (F.sum("l_quantity") / 2).alias("q"))
    files = orders.groupBy(F.floor(F.col("l_orderkey") / 4096).alias("file")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "n", "q"))).alias("o"))
    wide = 4096  # a place for each key that a file may hold
    place = lambda x: F.pmod(x["l_orderkey"], F.lit(wide)).cast("int")
    held = F.map_from_entries(F.transform("o", lambda x: F.struct(place(x).alias("k"), x.alias("x"))))
    chunk = lambda c: F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda k: F.coalesce(F.try_element_at(F.col("held"), k)[c], F.lit(-1.0)))
    content = F.concat(binary.raw_bytes(chunk("n"), "short"), binary.raw_bytes(chunk("q"), "double", swap=True))
    binary.save(files.withColumn("held", held).select(F.concat(F.col("file").cast("string"), F.lit(".flex")).alias("name"), content.alias("content")), folder)
    got = spans.raw_cells(spark, folder, [{"type": "short", "dims": [wide]}, {"type": "double", "dims": [wide], "swap": True}], per=100)
    key = F.regexp_extract("file", r"([0-9]+)[.]flex$", 1).cast("long") * wide + F.col("i")[0]
    return got.where("v >= 0").select(key.alias("l_orderkey"), "unit", "v")

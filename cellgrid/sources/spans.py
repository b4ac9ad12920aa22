"""Large binary files in ranges: headers are read first, then spans of items are dealt to tasks, each of which seeks its own.

A span holds so many items of one array, table or mesh that it takes about ``SPAN`` bytes, whatever the file's size.
Files are opened by the executors, in a folder that all of them mount or a store that pyarrow reaches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.functions import rice
from cellgrid.sources import binary

SPAN = 1 << 22
HEADERS = "file string, unit int, header map<string,string>, at long, size long"


def _ranges(file: str) -> Callable[[int, int], bytes]:
    """``read(at, n)`` of a file; fewer bytes than asked for are an error."""
    system, place = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", quote(file, safe=":/")))
    opened = system.open_input_file(place)

    def read(at: int, n: int) -> bytes:
        data = opened.read_at(n, at)
        if len(data) < n:
            raise ValueError(f"{file} ends within its data")
        return data

    return read


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length)``; contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def _dealt(units: DataFrame, items: Column, width: Column, per: int | None) -> DataFrame:
    """Spans ``first, n`` of the units' items, ``width`` bytes each, spread over the tasks of a shuffle."""
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = F.lit(per) if per else F.greatest(F.floor(F.lit(SPAN) / F.greatest(width, F.lit(1))), F.lit(1))
    counted = units.withColumns({"_items": items.cast("long"), "_each": each.cast("long")}).where("_items > 0")
    spans = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_items") - 1, F.col("_each"))))
    return spans.withColumn("n", F.least("_each", F.col("_items") - F.col("first"))).drop("_items", "_each").repartition(tasks, "file", "unit", "first")


def _by_span(spans: DataFrame, schema: str, parse: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``file, unit`` and the rows ``parse(read, span)`` makes of each span, a batch for each."""
    names = re.findall(r"(?:^|, )(\w+) ", schema)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for span in b.itertuples(index=False):
                rows = list(parse(_ranges(span.file), span))
                yield pd.DataFrame({"file": [span.file] * len(rows), "unit": [span.unit] * len(rows), **{c: pd.Series([x[k] for x in rows], dtype=object) for k, c in enumerate(names)}})

    return spans.mapInPandas(of, f"file string, unit int, {schema}")


def _cells(pieces: DataFrame) -> DataFrame:
    """``(file, unit, i, v)`` of pieces ``(first, data)`` of arrays of a ``shape``; values that are no numbers are null."""
    flat = pieces.select("file", "unit", "shape", "first", F.posexplode("data").alias("_p", "v"))
    return flat.select("file", "unit", binary.coordinates(F.col("shape"), F.col("first") + F.col("_p")).alias("i"), F.nanvl("v", F.lit(None)).alias("v"))


def _numbers(units: DataFrame, per: int | None) -> DataFrame:
    """Cells of units ``(file, unit, shape, kind, at, scale, zero, blank)`` of numbers of a numpy ``kind``."""
    width = F.regexp_extract("kind", r"(\d+)$", 1).cast("long")
    items = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)

    def parse(read: Callable[[int, int], bytes], s) -> Iterator[tuple]:
        kind = np.dtype(s.kind)
        raw = np.frombuffer(read(int(s.at + s.first * kind.itemsize), int(s.n * kind.itemsize)), kind)
        v = raw.astype(float)
        if not pd.isna(s.blank):
            v[raw == int(s.blank)] = np.nan
        yield s.shape, s.first, v * s.scale + s.zero

    return _cells(_by_span(_dealt(units, items, width, per), "shape array<long>, first long, data array<double>", parse))


def raw_cells(spark: SparkSession, path: str, chunks: list[dict], per: int | None = None) -> DataFrame:
    """``(file, unit, i, v)`` of files of chunks ``{type, dims, swap, offset}``, one behind another, each a unit.

    ``offset`` bytes are left out before a chunk.  A file that ends within its chunks is an error; ``per`` items make
    a span, or as many as take ``SPAN`` bytes.  A chunk without items gives no rows.
    """
    at, units = 0, []
    for k, c in enumerate(chunks):
        kind = (">" if c.get("swap") else "<") + binary.RAW_TYPES[c["type"]]
        at += int(c.get("offset", 0))
        units.append(F.struct(F.lit(k).alias("unit"), F.array(*[F.lit(int(d)).cast("long") for d in c["dims"]]).alias("shape"), F.lit(kind).alias("kind"), F.lit(at).cast("long").alias("at")))
        at += int(np.prod(c["dims"], dtype=object)) * np.dtype(kind).itemsize
    laid = _files(spark, path).select("file", F.inline(F.array(*units)))
    return _numbers(laid.withColumns({"scale": F.lit(1.0), "zero": F.lit(0.0), "blank": F.lit(None).cast("long")}), per)


# FITS ----------------------------------------------------------------------------------------------


def fits_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(file, unit, header, at, size)`` of each unit: its cards as text and where its data are; only headers are read."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, length in zip(b["file"], b["length"], strict=True):
                found = [(file, k, {n: str(v) for n, v in h.items()}, at, size) for k, (h, at, size) in enumerate(binary.fits_places(_ranges(file), int(length)))]
                yield pd.DataFrame(found, columns=["file", "unit", "header", "at", "size"])

    return _files(spark, path).mapInPandas(of, HEADERS)


def _card(name: str, default: object = None, kind: str = "long") -> Column:
    return F.coalesce(F.col("header")[name].cast(kind), F.lit(default).cast(kind))


def _axes(prefix: str = "NAXIS") -> Column:
    n = _card(prefix, 0)
    cards = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: F.try_element_at("header", F.concat(F.lit(prefix), k.cast("string"))).cast("long"))
    return F.when(n > 0, cards).otherwise(F.array().cast("array<long>"))


def fits_cells(spark: SparkSession, path: str, bscale: bool = True, per: int | None = None) -> DataFrame:
    """``(file, unit, i, v)`` of image units of any size; blank pixels and NaN are null, BSCALE and BZERO applied.

    Units without axes give no rows.
    """
    images = fits_headers(spark, path).where((F.trim(F.coalesce(F.col("header")["XTENSION"], F.lit("IMAGE"))) == "IMAGE") & (_card("NAXIS", 0) > 0))
    kinds = F.create_map(*[F.lit(x) for pair in binary.FITS_PIXELS.items() for x in (pair[0], pair[1])])
    laid = images.select("file", "unit", _axes().alias("shape"), F.try_element_at(kinds, _card("BITPIX").cast("int")).alias("kind"), "at", (_card("BSCALE", 1, "double") if bscale else F.lit(1.0)).alias("scale"), (_card("BZERO", 0, "double") if bscale else F.lit(0.0)).alias("zero"), _card("BLANK").alias("blank"))
    return _numbers(laid, per)


def _tables(spark: SparkSession, path: str) -> DataFrame:
    return fits_headers(spark, path).where(F.trim(F.col("header")["XTENSION"]) == "BINTABLE")


def _rows(read: Callable[[int, int], bytes], s) -> np.ndarray:
    kind = binary.fits_fields(s.header)
    width = int(s.header["NAXIS1"])
    if kind.itemsize != width:
        raise ValueError(f"{s.file}: rows of {width} bytes whose columns take {kind.itemsize}")
    return np.frombuffer(read(int(s.at + s.first * width), int(s.n * width)), kind)


def rfits_table(spark: SparkSession, path: str, per: int | None = None) -> DataFrame:
    """``(file, unit, row, fields)`` of binary tables of any size: each column's values as text by name, repeated names numbered."""

    def parse(read: Callable[[int, int], bytes], s) -> Iterator[tuple]:
        for k, row in enumerate(_rows(read, s)):
            yield s.first + k, {c: [x.decode("latin-1").rstrip() if isinstance(x, bytes) else str(x) for x in np.atleast_1d(row[c]).tolist()] for c in row.dtype.names}

    return _by_span(_dealt(_tables(spark, path), _card("NAXIS2", 0), _card("NAXIS1", 1), per), "row long, fields map<string,array<string>>", parse)


def _parameter(header: dict, name: str, default: int) -> int:
    for k in range(1, 1 + sum(c.startswith("ZNAME") for c in header)):
        if header.get(f"ZNAME{k}", "").strip() == name:
            return int(header[f"ZVAL{k}"])
    return default


def _heap(read: Callable[[int, int], bytes], s, places: np.ndarray, width: int) -> list[bytes]:
    """What the pairs (length, place) point to, in one read from the first to the last byte of it."""
    begin = int(s.at) + int(s.header.get("THEAP", int(s.header["NAXIS1"]) * int(s.header["NAXIS2"])))
    used = places[places[:, 0] > 0].astype(np.int64)
    if not len(used):
        return [b""] * len(places)
    low, high = int(used[:, 1].min()), int((used[:, 1] + used[:, 0] * width).max())
    data = read(begin + low, high - low)
    return [data[int(p) - low : int(p) - low + int(n) * width] if n > 0 else b"" for n, p in places]


def fits_tiled_cells(spark: SparkSession, path: str, per: int | None = None) -> DataFrame:
    """``(file, unit, i, v)`` of images that are stored as tables of Rice-coded tiles (ZIMAGE), tiles dealt to tasks.

    A tile that has no stream is taken from UNCOMPRESSED_DATA.  ZSCALE and ZZERO, of a tile or of all, and then BSCALE
    and BZERO are applied; ZBLANK is null.  Tiles at the far ends are cut to the image, as the format says.  Other
    codes than RICE_1 are an error.
    """
    known = F.col("header")["ZCMPTYPE"]
    tables = _tables(spark, path).where(F.col("header")["ZIMAGE"] == "True")
    checked = tables.withColumn("size", F.when(F.trim(known) == "RICE_1", F.col("size")).otherwise(F.raise_error(F.concat(F.lit("compressed by "), F.coalesce(known, F.lit("nothing named")))).cast("long")))

    def parse(read: Callable[[int, int], bytes], s) -> Iterator[tuple]:
        h, rows = s.header, _rows(read, s)
        axes = range(1, int(h["ZNAXIS"]) + 1)
        dims = np.array([int(h[f"ZNAXIS{k}"]) for k in axes])
        tile = np.array([int(h.get(f"ZTILE{k}", h["ZNAXIS1"] if k == 1 else 1)) for k in axes])
        grid = -(-dims // tile)
        start = np.stack(np.unravel_index(np.arange(s.first, s.first + s.n), grid, order="F"), axis=1) * tile
        extent = np.minimum(tile, dims - start)
        count = extent.prod(axis=1)
        bitpix = int(h["ZBITPIX"])
        width = _parameter(h, "BYTEPIX", abs(bitpix) // 8 if bitpix > 0 else 4)
        streams = _heap(read, s, rows["COMPRESSED_DATA"], 1)
        out: list[np.ndarray | None] = [None] * len(rows)
        for n in np.unique(count):
            at = [k for k in np.flatnonzero(count == n) if streams[k]]
            for k, x in zip(at, rice.decode([streams[k] for k in at], int(n), {1: "u1", 2: "i2", 4: "i4"}[width], _parameter(h, "BLOCKSIZE", 32)), strict=True):
                out[k] = x
        if any(x is None for x in out):
            if "UNCOMPRESSED_DATA" not in rows.dtype.names:
                raise ValueError(f"{s.file}: a tile has neither a stream nor plain samples")
            kind = np.dtype(binary.FITS_PIXELS[bitpix])
            plain = _heap(read, s, rows["UNCOMPRESSED_DATA"], kind.itemsize)
            out = [np.frombuffer(plain[k], kind) if x is None else x for k, x in enumerate(out)]
        scale, zero, blank = (rows[c] if c in rows.dtype.names else np.full(len(rows), float(h.get(c, d))) for c, d in (("ZSCALE", 1), ("ZZERO", 0), ("ZBLANK", np.nan)))
        for k, x in enumerate(out):
            v = np.where(x == blank[k], np.nan, x.astype(float)) if streams[k] else x.astype(float)
            v = v * float(scale[k]) + float(zero[k]) if streams[k] else v
            yield start[k], extent[k], v * float(h.get("BSCALE", 1)) + float(h.get("BZERO", 0))

    items = _card("NAXIS2", 0)
    width = F.floor(F.col("size") / F.greatest(items, F.lit(1)))
    tiles = _by_span(_dealt(checked, items, width, per), "start array<long>, extent array<long>, data array<double>", parse)
    flat = tiles.select("file", "unit", "start", "extent", F.posexplode("data").alias("_p", "v"))
    at = F.zip_with("start", binary.coordinates(F.col("extent"), F.col("_p")), lambda a, b: a + b)
    return flat.select("file", "unit", at.alias("i"), F.nanvl("v", F.lit(None)).alias("v"))


def tiled_fits_bytes(data: np.ndarray, tile: list[int] | None = None, header: dict | None = None, block: int = 32) -> bytes:
    """A FITS file of one integer image (u1, i2 or i4; its last axis is the first dimension) as a table of Rice-coded tiles.

    A tile is a row of the image unless told otherwise.  A tile that Rice coding would make longer is stored as it is.
    """
    dims = data.shape[::-1]
    sides = tile or [dims[0]] + [1] * (data.ndim - 1)
    grid = [-(-d // t) for d, t in zip(dims, sides, strict=True)]
    size, bitpix = data.dtype.itemsize, binary.FITS_BITPIX[data.dtype.str[1:]]
    rows = np.zeros((int(np.prod(grid)), 4), ">i4")
    heap, at = [], 0
    for k in range(len(rows)):
        place = np.unravel_index(k, grid, order="F")
        part = data[tuple(slice(p * t, (p + 1) * t) for p, t in zip(place[::-1], sides[::-1], strict=True))].reshape(1, -1)
        stream = rice.encode(np.ascontiguousarray(part), block)[0]
        kept = len(stream) < part.nbytes
        body = stream if kept else part.astype(binary.FITS_PIXELS[bitpix]).tobytes()
        rows[k, 0 if kept else 2 : 2 if kept else 4] = len(body) // (1 if kept else size), at
        heap.append(body)
        at += len(body)
    empty = binary.fits_unit({"SIMPLE": True, "BITPIX": 8, "NAXIS": 0, "EXTEND": True}, b"")
    code = {1: "B", 2: "I", 4: "J"}[size]
    cards = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": 16, "NAXIS2": len(rows), "PCOUNT": at, "GCOUNT": 1, "TFIELDS": 2}
    cards |= {"TTYPE1": "COMPRESSED_DATA", "TFORM1": f"1PB({int(rows[:, 0].max(initial=0))})", "TTYPE2": "UNCOMPRESSED_DATA", "TFORM2": f"1P{code}({int(rows[:, 2].max(initial=0))})"}
    cards |= {"ZIMAGE": True, "ZCMPTYPE": "RICE_1", "ZBITPIX": bitpix, "ZNAXIS": data.ndim}
    cards |= {f"ZNAXIS{k + 1}": int(d) for k, d in enumerate(dims)} | {f"ZTILE{k + 1}": int(t) for k, t in enumerate(sides)}
    cards |= {"ZNAME1": "BLOCKSIZE", "ZVAL1": block, "ZNAME2": "BYTEPIX", "ZVAL2": size}
    return empty + binary.fits_unit(cards | (header or {}), rows.tobytes() + b"".join(heap))


def tiled_fits_of(data: Column, shape: Column, dtype: str = "i4", tile: list[int] | None = None) -> Column:
    """A packed integer array and its shape as the bytes of a FITS file of Rice-coded tiles; null if either is."""

    @F.pandas_udf("binary")
    def of(values: pd.Series, shapes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or n is None else tiled_fits_bytes(np.asarray(x).astype(dtype).reshape([int(k) for k in n][::-1]), tile) for x, n in zip(values, shapes, strict=True)], dtype=object)

    return of(data, shape)


# STL -----------------------------------------------------------------------------------------------


def rstl(spark: SparkSession, path: str, per: int | None = None) -> DataFrame:
    """``(file, face, corner, x, y, z)`` of meshes: ranges of faces of binary files, text files whole."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [int.from_bytes(_ranges(f)(80, 4), "little") if n >= 84 else -1 for f, n in zip(b["file"], b["length"], strict=True)]
            yield b.assign(unit=0, faces=[c if n == 84 + 50 * c else -1 for c, n in zip(counts, b["length"], strict=True)])

    def parse(read: Callable[[int, int], bytes], s) -> Iterator[tuple]:
        whole = s.faces < 0
        content = read(0, int(s.length)) if whole else bytes(80) + int(s.n).to_bytes(4, "little") + read(int(84 + 50 * s.first), int(50 * s.n))
        for f, face in enumerate(binary.parse_stl(content).tolist()):
            for c, (x, y, z) in enumerate(face):
                yield (f if whole else s.first + f), c, x, y, z

    meshes = _files(spark, path).mapInPandas(of, "file string, length long, unit int, faces long")
    spans = _dealt(meshes, F.when(F.col("faces") < 0, 1).otherwise(F.col("faces")), F.lit(50), per)
    return _by_span(spans, "face long, corner int, x double, y double, z double", parse).drop("unit")

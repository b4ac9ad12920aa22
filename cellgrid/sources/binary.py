"""Binary array files: raw arrays with text headers, FITS images and tables, PNM images, STL meshes.

Here files are read whole by Spark's ``binaryFile`` source, one row per file, and opened into packed arrays in Arrow
batches; ``spans`` deals ranges of large files to tasks.  Writers encode packed arrays into a column of
bytes, and ``save`` has the executors write such columns as files.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of raw headers; FITS codes of pixels and table columns.
RAW_TYPES = {"sbyte": "i1", "byte": "u1", "short": "i2", "ushort": "u2", "long": "i4", "ulong": "u4", "longlong": "i8", "indx": "i8", "ulonglong": "u8", "float": "f4", "double": "f8"}
FITS_PIXELS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
FITS_COLUMNS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}
FITS_BLOCK, FITS_CARD = 2880, 80


def _opened(spark: SparkSession, path: str, schema: str, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """``file`` and the fields of ``schema`` for each row that ``parse`` makes of a file."""
    names = re.findall(r"(?:^|, )(\w+) ", schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = list(parse(content))
                yield pd.DataFrame({"file": [file] * len(rows), **{n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, f"file string, {schema}")


def save(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write each row's bytes as a file in a folder that all executors mount; how many were written.

    A file gets its name only once it is whole, so a repeated task leaves none half written.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, data in zip(b["name"], b["content"], strict=True):
                part = Path(folder) / f".{n}.{uuid.uuid4().hex}"
                part.write_bytes(data)
                part.replace(Path(folder) / n)
            yield pd.DataFrame({"n": [len(b)]})

    Path(folder).mkdir(parents=True, exist_ok=True)
    done = files.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInPandas(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _encoded(columns: list[Column], encode: Callable[..., bytes]) -> Column:
    """A column of bytes from packed arrays and their shapes; null if any is."""

    @F.pandas_udf("binary")
    def of(data: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or n is None else encode(np.asarray(x, float), [int(k) for k in n]) for x, n in zip(data, shape, strict=True)])

    return of(*columns)


def glue(spark: SparkSession, folder: str, more: DataFrame, into: str, name: str = "name", content: str = "content") -> int:
    """Files of a folder with further bytes behind them, by name, written to another folder; files without stay as they are."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("content").alias("_old"))
    both = files.join(more.select(F.col(name).alias("name"), F.col(content).alias("_new")), "name", "left")
    return save(both.select("name", F.concat("_old", F.coalesce("_new", F.lit(b""))).alias("content")), into)


ARRAY = "dtype string, shape array<long>, data array<double>"


def readraw(spark: SparkSession, path: str, dtype: str, shape: list[int], swap: bool = False, offset: int = 0) -> DataFrame:
    """Raw arrays of one layout, one packed row per file."""
    kind = np.dtype((">" if swap else "<") + RAW_TYPES[dtype])

    def parse(content: bytes) -> Iterator[tuple]:
        yield dtype, shape, np.frombuffer(content, kind, int(np.prod(shape)), offset).astype(float).tolist()

    return _opened(spark, path, ARRAY, parse)


def readflex(spark: SparkSession, path: str, chunks: list[dict]) -> DataFrame:
    """Chunks ``{type, dims, swap}`` that lie one behind another in each file: a row per chunk."""

    def parse(content: bytes) -> Iterator[tuple]:
        at = 0
        for c in chunks:
            kind = np.dtype((">" if c.get("swap") else "<") + RAW_TYPES[c["type"]])
            n = int(np.prod(c["dims"]))
            yield c["type"], c["dims"], np.frombuffer(content, kind, n, at).astype(float).tolist()
            at += n * kind.itemsize

    return _opened(spark, path, ARRAY, parse)


def parse_flexhdr(text: str) -> list[dict]:
    """Chunks of a header file: lines of a type, a number of dimensions and the dimensions; # starts a comment."""
    out, swap = [], False
    for line in text.splitlines():
        words = line.partition("#")[0].split()
        if words[:1] == ["swap"]:
            swap = True
        elif words:
            out.append({"type": words[0].lower(), "dims": [int(x) for x in words[2 : 2 + int(words[1])]], "swap": swap})
    return out


def write_flexhdr(chunks: list[dict]) -> str:
    return "".join(f"{c['type']} {len(c['dims'])} {' '.join(map(str, c['dims']))}\n" for c in chunks)


def raw_bytes(data: Column, dtype: str, swap: bool = False) -> Column:
    """A packed array as little-endian bytes, or big-endian ones."""

    @F.pandas_udf("binary")
    def of(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.asarray(x).astype((">" if swap else "<") + RAW_TYPES[dtype]).tobytes() for x in v])

    return of(data)


# FITS ----------------------------------------------------------------------------------------------


def _fits_value(text: str) -> object:
    text = text.strip()
    if text.startswith("'"):
        return re.match(r"'((?:[^']|'')*)'", text)[1].replace("''", "'").rstrip()
    text = text.partition("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        return float(text.replace("D", "E")) if text else None


def fits_places(read: Callable[[int, int], bytes], length: int) -> Iterator[tuple[dict, int, int]]:
    """(header, where its data begin, their bytes) of each unit of a file, of which ``read(at, n)`` gives ranges."""
    at = 0
    while at + FITS_BLOCK <= length:
        header: dict[str, object] = {}
        ended = False
        while not ended and at < length:
            block = read(at, FITS_BLOCK).decode("latin-1")
            at += FITS_BLOCK
            for card in (block[i : i + FITS_CARD] for i in range(0, FITS_BLOCK, FITS_CARD)):
                name = card[:8].strip().upper()
                ended = ended or name == "END"
                if not ended and card[8:10] == "= ":
                    header[name] = _fits_value(card[10:])
        dims = [int(header.get(f"NAXIS{i}", 0)) for i in range(1, int(header.get("NAXIS", 0)) + 1)]
        size = (abs(int(header.get("BITPIX", 8))) // 8) * int(header.get("GCOUNT", 1)) * (int(header.get("PCOUNT", 0)) + int(np.prod(dims)) if dims else 0)
        yield header, at, size
        at += -(-size // FITS_BLOCK) * FITS_BLOCK


def fits_units(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header, data) of each unit of a file."""
    for header, at, size in fits_places(lambda at, n: content[at : at + n], len(content)):
        yield header, content[at : at + size]


def rfitshdr(spark: SparkSession, path: str) -> DataFrame:
    """``(file, unit, header)``: a map of text per unit."""

    def parse(content: bytes) -> Iterator[tuple]:
        for k, (h, _) in enumerate(fits_units(content)):
            yield k, {n: str(v) for n, v in h.items()}

    return _opened(spark, path, "unit int, header map<string,string>", parse)


def rfits(spark: SparkSession, path: str, bscale: bool = True) -> DataFrame:
    """``(file, unit, shape, data)`` of image units; blank pixels and NaN are null, BSCALE and BZERO applied."""

    def parse(content: bytes) -> Iterator[tuple]:
        for k, (h, data) in enumerate(fits_units(content)):
            dims = [int(h[f"NAXIS{i}"]) for i in range(1, int(h.get("NAXIS", 0)) + 1)]
            if not dims or h.get("XTENSION", "IMAGE").strip() != "IMAGE":
                continue
            raw = np.frombuffer(data, FITS_PIXELS[int(h["BITPIX"])], int(np.prod(dims)))
            v = raw.astype(float)
            bad = np.isnan(v) if "BLANK" not in h else raw == h["BLANK"]
            if bscale:
                v = v * float(h.get("BSCALE", 1)) + float(h.get("BZERO", 0))
            yield k, dims, [None if b else x for x, b in zip(v.tolist(), bad.tolist(), strict=True)]

    return _opened(spark, path, "unit int, shape array<long>, data array<double>", parse)


def fits_fields(header: dict) -> np.dtype:
    """The layout of a binary table's rows: repeated names are numbered, a column of a varying length is a pair (length, place)."""
    fields, seen = [], {}
    for i in range(1, int(header["TFIELDS"]) + 1):
        count, code = re.match(r"(\d*)([A-Z])", str(header[f"TFORM{i}"]).strip()).groups()
        name = str(header.get(f"TTYPE{i}") or f"COL_{i}").strip()
        seen[name] = seen.get(name, -1) + 1
        n = int(count or 1)
        kind, shape = (f"S{n}", ()) if code == "A" else ({"P": ">i4", "Q": ">i8"}[code], (2 * n,)) if code in "PQ" else (FITS_COLUMNS[code], () if n == 1 else (n,))
        fields.append((name if not seen[name] else f"{name}_{seen[name]}", kind, shape))
    return np.dtype(fields)


FITS_BITPIX = {"u1": 8, "i2": 16, "i4": 32, "i8": 64, "f4": -32, "f8": -64}


def fits_unit(header: dict, body: bytes) -> bytes:
    """A unit of a FITS file: cards in the order given, data, both filled up to whole blocks."""
    cards = []
    for name, value in header.items():
        text = f"'{value}'" if isinstance(value, str) else f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"{value!r:>20}"
        cards.append(f"{name.upper():<8}= {text}")
    head = "".join(f"{c:<80}" for c in [*cards, "END"])
    pad = lambda n: -n % FITS_BLOCK
    return (head + " " * pad(len(head))).encode() + body + bytes(pad(len(body)))


def fits_bytes(data: np.ndarray, header: dict | None = None) -> bytes:
    """A FITS file of one image; the array's last axis is the first dimension.  NaN stays NaN."""
    bitpix = FITS_BITPIX[data.dtype.str[1:]]
    axes = {f"NAXIS{i + 1}": n for i, n in enumerate(reversed(data.shape))}
    return fits_unit({"SIMPLE": True, "BITPIX": bitpix, "NAXIS": data.ndim, **axes, **(header or {})}, data.astype(FITS_PIXELS[bitpix]).tobytes())


def fits_of(data: Column, shape: Column, dtype: str = "f8", header: dict | None = None) -> Column:
    """A packed array, first dimension fastest, and its shape as the bytes of a FITS image."""
    return _encoded([data, shape], lambda x, n: fits_bytes(x.astype(dtype).reshape(n[::-1]), header))


# PNM -----------------------------------------------------------------------------------------------


def parse_pnm(content: bytes) -> tuple[list[int], np.ndarray]:
    """Shape (channels first if three) and samples of a P1-P6 image, rows from the top."""
    fields, at = [], 2
    magic = content[:2]
    while len(fields) < (2 if magic in (b"P1", b"P4") else 3):
        m = re.compile(rb"\s*(?:#[^\n]*\n\s*)*(\d+)").match(content, at)
        fields.append(int(m[1]))
        at = m.end()
    w, h = fields[:2]
    channels = 3 if magic in (b"P3", b"P6") else 1
    if magic == b"P4":
        rows = np.frombuffer(content, np.uint8, h * (-(-w // 8)), at + 1).reshape(h, -1)
        v = 1 - np.unpackbits(rows, axis=1)[:, :w].ravel()
    elif magic in (b"P5", b"P6"):
        v = np.frombuffer(content, np.uint8 if fields[2] < 256 else ">u2", w * h * channels, at + 1)
    else:
        text = re.sub(rb"#[^\n]*", b"", content[at:])
        v = np.array(list(text.translate(None, b" \t\r\n")) if magic == b"P1" else text.split(), float)[: w * h * channels]
        v = 1 - (v - 48) if magic == b"P1" else v
    return ([3, w, h] if channels == 3 else [w, h]), v.astype(float)


def rpnm(spark: SparkSession, path: str) -> DataFrame:
    def parse(content: bytes) -> Iterator[tuple]:
        shape, v = parse_pnm(content)
        yield shape, v.tolist()

    return _opened(spark, path, "shape array<long>, data array<double>", parse)


def pnm_bytes(data: np.ndarray, raw: bool = True) -> bytes:
    """Rows of grey levels, or of RGB triples, as PGM or PPM."""
    h, w = data.shape[:2]
    kind = (5 if raw else 2) + (data.ndim == 3)
    head = f"P{kind}\n{w} {h}\n255\n".encode()
    return head + (data.astype(np.uint8).tobytes() if raw else ("\n".join(" ".join(map(str, r)) for r in data.reshape(h, -1).astype(int).tolist()) + "\n").encode())


def pnm_of(data: Column, shape: Column, raw: bool = True) -> Column:
    """A packed grey array (width, height), or colours (3, width, height), as the bytes of a PGM or PPM."""
    return _encoded([data, shape], lambda x, n: pnm_bytes(x.reshape(n[::-1]), raw))


def imageformat(content: Column) -> Column:
    """Name of an image format by its first bytes."""
    hexed = F.hex(F.substring(content, 1, 8))
    # File signatures.
    signs = {"89504E47": "PNG", "47494638": "GIF", "FFD8FF": "JPEG", "53494D504C45": "FITS", "49492A00": "TIFF", "4D4D002A": "TIFF", "5031": "PNM", "5032": "PNM", "5033": "PNM", "5034": "PNM", "5035": "PNM", "5036": "PNM"}
    out = F.lit("unknown")
    for sign, name in signs.items():
        out = F.when(F.startswith(hexed, F.lit(sign)), name).otherwise(out)
    return out


# STL -----------------------------------------------------------------------------------------------


def parse_stl(content: bytes) -> np.ndarray:
    """Corners (faces, 3, 3) of a text or binary mesh."""
    if len(content) >= 84 and len(content) == 84 + 50 * struct.unpack_from("<I", content, 80)[0]:
        kind = np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
        return np.frombuffer(content, kind, offset=84)["v"].astype(float)
    return np.array([x.split()[1:4] for x in re.findall(rb"vertex[^\n]*", content)], float).reshape(-1, 3, 3)


def mesh_vertices(corners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct vertices ``(vertex, x, y, z)`` numbered per file, and ``(face, corner, vertex)``."""
    from pyspark.sql import Window

    xyz = ["x", "y", "z"]
    vertices = corners.select("file", *xyz).distinct().withColumn("vertex", F.row_number().over(Window.partitionBy("file").orderBy(*xyz)).cast("long") - 1)
    return vertices, corners.join(vertices, ["file", *xyz]).select("file", "face", "corner", "vertex")


def stl_bytes(corners: np.ndarray) -> bytes:
    """Binary mesh of corners (faces, 3, 3), with normals."""
    c = np.asarray(corners, float)
    n = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
    size = np.linalg.norm(n, axis=1, keepdims=True)
    rows = np.zeros(len(c), np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    rows["n"], rows["v"] = n / np.where(size == 0, 1, size), c
    return b"\0" * 80 + struct.pack("<I", len(c)) + rows.tobytes()


def stl_of(corners: Column) -> Column:
    """A packed array of faces, each nine coordinates, as the bytes of a binary mesh."""
    return _encoded([corners, F.array(F.size(corners))], lambda x, n: stl_bytes(x.reshape(-1, 3, 3)))


def cells(packed: DataFrame, data: str = "data", shape: str = "shape") -> DataFrame:
    """Packed arrays as cells: the other columns, ``i`` (coordinates) and ``v``."""
    others = [c for c in packed.columns if c not in (data, shape)]
    flat = packed.select(*others, F.col(shape).alias("_s"), F.posexplode(data).alias("_p", "v"))
    return flat.select(*others, coordinates(F.col("_s"), F.col("_p")).alias("i"), "v")


def coordinates(shape: Column, place: Column) -> Column:
    """Coordinates of a place in an array whose first dimension is the fastest."""
    start = F.struct(F.array().cast("array<bigint>").alias("i"), place.cast("long").alias("r"))
    return F.aggregate(shape, start, lambda s, n: F.struct(F.concat(s["i"], F.array(F.pmod(s["r"], n))).alias("i"), F.floor(s["r"] / n).alias("r")))["i"]

"""Fourier transforms of packed vectors, and images as cells ``(i, j, v)`` with broadcast keys."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from functools import reduce as fold
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.operators import ranged
from cellgrid.operators.graph import connected_components
from cellgrid.operators.linalg import by_shape

# Cells of a tile's side: a task holds a tile and its surroundings.
TILE = 128


def _fourier(kind: str, re: Column, im: Column) -> Column:
    @F.pandas_udf("re array<double>, im array<double>")
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        z = [None if x is None or y is None else np.asarray(x, float) + 1j * np.asarray(y, float) for x, y in zip(a, b, strict=True)]
        found = by_shape(z, lambda rows: getattr(np.fft, kind)(rows, axis=1))
        return pd.DataFrame([(None, None) if x is None else (x.real, x.imag) for x in found], columns=["re", "im"])

    return of(re, im)


def fft(re: Column, im: Column) -> Column:
    return _fourier("fft", re, im)


def ifft(re: Column, im: Column) -> Column:
    """Normalised inverse."""
    return _fourier("ifft", re, im)


def realfft(x: Column) -> Column:
    """Real transform packed in place: real parts of orders 0..n/2, then imaginary parts of orders 1..(n-1)/2."""

    @F.pandas_udf("array<double>")
    def of(v: pd.Series) -> pd.Series:
        def packed(x: np.ndarray) -> np.ndarray:
            z = np.fft.rfft(x, axis=1)
            return np.concatenate([z.real, z.imag[:, 1 : (x.shape[1] + 1) // 2]], axis=1)

        return pd.Series(by_shape([None if x is None else np.asarray(x, float) for x in v], packed), dtype=object)

    return of(x)


def realifft(packed: Column) -> Column:
    @F.pandas_udf("array<double>")
    def of(v: pd.Series) -> pd.Series:
        def unpacked(p: np.ndarray) -> np.ndarray:
            n = p.shape[1]
            z = p[:, : n // 2 + 1].astype(complex)
            z[:, 1 : (n + 1) // 2] += 1j * p[:, n // 2 + 1 :]
            return np.fft.irfft(z, n, axis=1)

        return pd.Series(by_shape([None if p is None else np.asarray(p, float) for p in v], unpacked), dtype=object)

    return of(packed)


def fftconvolve(x: Column, kernel: Column) -> Column:
    """Periodic convolution of packed vectors, the kernel's first element at offset 0."""

    @F.pandas_udf("array<double>")
    def of(a: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else np.fft.ifft(np.fft.fft(np.asarray(x, float)) * np.fft.fft(np.asarray(y, float), len(x))).real.tolist() for x, y in zip(a, k, strict=True)])

    return of(x, kernel)


# long vectors and arrays as cells --------------------------------------------------------------------


def _axis_dft(cells: DataFrame, by: list[str], i: str, n: int, inverse: bool) -> DataFrame:
    """Transform along one dimension ``i`` of complex cells ``(by, i, re, im)``: a group's vector is one task's row.

    Absent cells of the ``n`` are 0; one beyond these, or there twice, is an error.
    """
    one = F.struct(F.col(i).cast("long").alias("i"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    packed = cells.groupBy(*by).agg(F.collect_list(one).alias("z"))
    kind = "ifft" if inverse else "fft"

    @F.pandas_udf("re array<double>, im array<double>")
    def of(places: pd.Series, re: pd.Series, im: pd.Series) -> pd.DataFrame:
        z = np.zeros((len(places), n), complex)
        for row, at, x, y in zip(z, places, re, im, strict=True):
            if len(at) != len(np.unique(at)) or at.min() < 0 or at.max() >= n:
                raise ValueError(f"cells of a vector of {n} are there twice, or beyond it")
            row[at] = np.asarray(x, float) + 1j * np.asarray(y, float)
        done = getattr(np.fft, kind)(z, axis=1)
        return pd.DataFrame({"re": list(done.real), "im": list(done.imag)})

    done = packed.select(*by, of(F.col("z.i"), F.col("z.re"), F.col("z.im")).alias("w"))
    return done.select(*by, F.posexplode(F.arrays_zip(F.col("w.re").alias("re"), F.col("w.im").alias("im"))).alias(i, "z")).select(*by, F.col(i).cast("long").alias(i), "z.re", "z.im")


def fft_cells(cells: DataFrame, by: list[str], i: str, rows: int, columns: int, inverse: bool = False) -> DataFrame:
    """Transform of vectors of ``rows * columns`` cells ``(by, i, re, im)``, however long they are; absent cells are 0.

    The index is taken as a matrix: columns are transformed, turned by the twiddle factors, and rows are
    transformed, so no task holds more of a vector than one row or column.
    """
    n = rows * columns
    apart = cells.select(*by, F.floor(F.col(i) / columns).alias("_a"), F.pmod(F.col(i).cast("long"), F.lit(columns)).alias("_b"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    first = _axis_dft(apart, [*by, "_b"], "_a", rows, inverse)
    angle = F.col("_a") * F.col("_b") * F.lit((2 if inverse else -2) * math.pi / n)
    re, im = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle), F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    second = _axis_dft(first.select(*by, "_a", "_b", re.alias("re"), im.alias("im")), [*by, "_a"], "_b", columns, inverse)
    return second.select(*by, (F.col("_a") + F.col("_b") * rows).cast("long").alias(i), "re", "im")


def fftnd(cells: DataFrame, by: list[str], dims: list[str], inverse: bool = False, shape: list[int] | None = None) -> DataFrame:
    """Transform of complex cells along several dimensions, one after another; absent cells are 0.

    Without a ``shape`` the largest indices tell it, by one job.
    """
    if shape is None:
        most = cells.agg(*[F.max(d) for d in dims]).first()
        shape = [0 if m is None else int(m) + 1 for m in most]
    for d, n in zip(dims, shape, strict=True):
        cells = _axis_dft(cells, [*by, *[x for x in dims if x != d]], d, n, inverse)
    return cells.select(*by, *dims, "re", "im")


def fftconvolve_long(cells: DataFrame, by: list[str], i: str, v: str, n: int, kernel: list[float], centred: bool = False, tile: int = 1 << 16, out: str = "v") -> DataFrame:
    """Periodic convolution of vectors of ``n`` cells, of any length, with a kernel of thousands of numbers: ``(by, i, out)``.

    Overlap and save: a tile of the result, as long as four kernels at least, takes its own cells and those a kernel's
    length before, so each cell is sent to one tile or two and no task holds more than a tile.  The kernel's first number is at
    offset 0, or its middle with ``centred``, as in ``conv1d``; a kernel longer than the vector is wrapped around it.

    Absent cells are 0, and all ``n`` of a group come out.  Where the kernel meets a null the result is null, and where
    it meets an infinite cell or one that is no number, NaN.  A cell beyond the vector, or there twice, is an error.
    """
    wrapped = np.zeros(min(len(kernel), n))
    np.add.at(wrapped, np.arange(len(kernel)) % max(n, 1), np.asarray(kernel, float))
    k, shift = len(wrapped), (len(kernel) - 1) // 2 if centred else 0
    if k == 0:
        raise ValueError("a kernel and a vector have one number at least")
    size = max(tile, 4 * k)
    m = 1 << (size + k - 2).bit_length()
    spectrum = np.fft.rfft(wrapped, m)
    tiles = -(-n // size)

    def to(place: Column) -> Column:
        return F.struct(F.floor(place / size).cast("long").alias("_t"), place.alias("_p"))

    def early(place: Column) -> Column:
        """The next tile, for a cell that lies less than a kernel's length before it."""
        ahead = F.floor(place / size).cast("long") + 1
        return F.when((ahead * size - place < k) & ahead.between(0, tiles - 1), F.struct(ahead.alias("_t"), place.alias("_p")))

    at = F.col(i).cast("long")
    checked = F.when((at >= 0) & (at < n), at).otherwise(F.raise_error(F.concat(F.lit(f"beyond a vector of {n}: "), F.coalesce(at.cast("string"), F.lit("a null index")))).cast("long"))
    sent = cells.select(*by, checked.alias("_at"), F.col(v).cast("double").alias("_v"), F.col(v).isNull().alias("_null"))
    spots = F.array_compact(F.array(to(F.col("_at")), early(F.col("_at")), early(F.col("_at") - n)))
    sent = sent.withColumn("_s", F.explode(spots)).select(*by, "_s._t", "_s._p", "_v", "_null")
    # a mark before its first cell makes each tile of a group one, though no cell be sent to it
    groups = cells.select(*by).distinct() if by else cells.limit(1).select()
    tile_of = groups.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    sent = sent.unionByName(tile_of.withColumns({"_p": F.col("_t") * size - k, "_v": F.lit(0.0), "_null": F.lit(False)}))

    def each(g: pd.DataFrame) -> pd.DataFrame:
        t = int(g["_t"].iloc[0])
        groups, g = g, g[g["_p"] >= t * size - k + 1]
        place = g["_p"].to_numpy() - (t * size - k + 1)
        if len(np.unique(place)) < len(place):
            raise ValueError("a cell of the vector is there twice")
        x, null, odd = np.zeros(size + k - 1), np.zeros(size + k, bool), np.zeros(size + k, bool)
        value = g["_v"].to_numpy(float)
        gone = g["_null"].to_numpy(bool)
        finite = np.isfinite(value)
        x[place] = np.where(finite, value, 0)
        null[place + 1], odd[place + 1] = gone, ~finite & ~gone
        length = min(size, n - t * size)
        y = np.fft.irfft(np.fft.rfft(x, m) * spectrum, m)[k - 1 : k - 1 + length]
        met = lambda flags: np.diff(np.stack([np.cumsum(flags)[:length], np.cumsum(flags)[k : k + length]]), axis=0)[0] > 0
        where = (t * size + np.arange(length) - shift) % n
        return pd.DataFrame({**{c: [groups[c].iloc[0]] * length for c in by}, i: where, out: y, "_null": met(null), "_odd": met(odd)})

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), f"`{i}` long", f"`{out}` double", "_null boolean", "_odd boolean"])
    done = sent.groupBy(*by, "_t").applyInPandas(each, schema)
    number = F.when(F.col("_odd"), F.lit(float("nan"))).otherwise(F.col(out))
    return done.select(*by, i, F.when(~F.col("_null"), number).alias(out))


def fftconvolve_cells(cells: DataFrame, kernel: DataFrame, by: list[str], i: str, rows: int, columns: int) -> DataFrame:
    """Periodic convolution of vectors of ``rows * columns`` cells ``(by, i, v)`` with a kernel of any length ``(i, v)``.

    The product of both transforms, each by ``fft_cells``, transformed back; absent cells are 0.  The kernel's cell 0 is at
    offset 0.
    """
    z = lambda df, keys: df.select(*keys, i, F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    a = fft_cells(z(cells, by), by, i, rows, columns)
    k = fft_cells(z(kernel, []), [], i, rows, columns).select(i, F.col("re").alias("_re"), F.col("im").alias("_im"))
    product = a.join(k, i).select(*by, i, (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"), (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"))
    return fft_cells(product, by, i, rows, columns, inverse=True).select(*by, i, F.col("re").alias("v"))


def kernctr(kernel: DataFrame, dims: list[str], kernel_shape: list[int], shape: list[int]) -> DataFrame:
    """A small kernel's cells shifted so that its middle is at the origin of an array of ``shape``, around the ends."""
    return kernel.withColumns({d: F.pmod(F.col(d) - k // 2, F.lit(n)).cast("long") for d, k, n in zip(dims, kernel_shape, shape, strict=True)})


def convolve_nd(cells: DataFrame, by: list[str], dims: list[str], shape: list[int], kernel: dict[tuple[int, ...], float], boundary: str = "periodic") -> DataFrame:
    """Convolution in any number of dimensions with a small kernel ``offset: weight``.

    Each cell is sent to the cells it bears on and one aggregation sums them, in part before the shuffle.
    Rules are periodic, or truncate (nothing beyond the ends).
    """
    if boundary not in ("periodic", "truncate"):
        raise ValueError(f"unknown boundary rule {boundary}")
    taps = F.array(*[F.struct(*[F.lit(o).alias(f"o{n}") for n, o in enumerate(offset)], F.lit(float(w)).alias("w")) for offset, w in kernel.items()])
    sent = cells.select(*by, *dims, "v", F.explode(taps).alias("_t"))
    to = [_edge(F.col(d) + F.col(f"_t.o{n}"), size, boundary).cast("long").alias(d) for n, (d, size) in enumerate(zip(dims, shape, strict=True))]
    moved = sent.select(*by, *to, (F.col("v") * F.col("_t.w")).alias("_p")).dropna(subset=dims)
    return moved.groupBy(*by, *dims).agg(F.when(F.count("*") == F.count("_p"), F.sum("_p")).alias("v"))


# images --------------------------------------------------------------------------------------------


def _edge(i: Column, n: int, boundary: str) -> Column:
    if boundary == "periodic":
        return F.pmod(i, F.lit(n))
    if boundary == "replicate":
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), i))
    if boundary == "reflect":
        j = F.pmod(i, F.lit(2 * n))
        return F.when(j < n, j).otherwise(2 * n - 1 - j)
    return F.when((i >= 0) & (i < n), i)


def _shown_at(i: Column, n: int, reach: int, boundary: str) -> Column:
    """Places from -reach to n - 1 + reach at which a cell is seen under a boundary rule."""
    i = i.cast("long")
    if boundary == "periodic":
        places = F.array(i, i - n, i + n)
    elif boundary == "reflect":
        places = F.array(i, -i - 1, 2 * n - 1 - i)
    elif boundary == "replicate":
        before, after = F.sequence(F.lit(-reach).cast("long"), F.lit(-1).cast("long")), F.sequence(F.lit(n).cast("long"), F.lit(n - 1 + reach).cast("long"))
        places = F.concat(F.array(i), F.when(i == 0, before).otherwise(F.array().cast("array<bigint>")), F.when(i == n - 1, after).otherwise(F.array().cast("array<bigint>"))) if reach else F.array(i)
    else:
        places = F.array(i)
    return F.filter(places, lambda p: (p >= -reach) & (p < n + reach))


def _tiled(img: DataFrame, by: list[str], shape: tuple[int, int], reach: tuple[int, int], boundary: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Cells of the image whose value is what ``of`` makes of their surroundings.

    Tiles of TILE x TILE cells get the cells within ``reach`` of them, once each, and are computed as dense arrays
    (NaN where there is no cell): ``of`` is given all windows, shaped (rows, columns, window, window).
    """
    if reach[0] > shape[0] or reach[1] > shape[1]:
        raise ValueError("a window reaches over the image more than once")

    def tiles(c: str, n: int, r: int) -> Column:
        last = F.lit((n - 1) // TILE).cast("long")
        return F.sequence(F.greatest(F.floor((F.col(c) - r) / TILE), F.lit(0).cast("long")), F.least(F.floor((F.col(c) + r) / TILE), last))

    seen = img.select(*by, "i", "j", F.col("v").cast("double").alias("v"), F.explode(_shown_at(F.col("i"), shape[0], reach[0], boundary)).alias("_i"))
    seen = seen.withColumn("_j", F.explode(_shown_at(F.col("j"), shape[1], reach[1], boundary)))
    sent = seen.withColumn("_ti", F.explode(tiles("_i", shape[0], reach[0]))).withColumn("_tj", F.explode(tiles("_j", shape[1], reach[1])))
    own = (F.col("_i") == F.col("i")) & (F.col("_j") == F.col("j")) & (F.floor(F.col("_i") / TILE) == F.col("_ti")) & (F.floor(F.col("_j") / TILE) == F.col("_tj"))
    kinds = {c: img.schema[c].dataType.simpleString() for c in [*by, "i", "j"]}

    def each(t: pd.DataFrame) -> pd.DataFrame:
        top, left = t["_ti"].iloc[0] * TILE - reach[0], t["_tj"].iloc[0] * TILE - reach[1]
        m = np.full((TILE + 2 * reach[0], TILE + 2 * reach[1]), np.nan)
        m[t["_i"] - top, t["_j"] - left] = t["v"].to_numpy(float)
        windows = np.lib.stride_tricks.sliding_window_view(m, (2 * reach[0] + 1, 2 * reach[1] + 1))
        out = t.loc[t["_own"], [*kinds]]
        got = pd.Series(dtype=float)
        if len(out):
            at = out["i"] - top - reach[0], out["j"] - left - reach[1]
            got = pd.Series(of(windows[: at[0].max() + 1, : at[1].max() + 1])[at], index=out.index)
        return out.assign(v=got.where(got.notna(), None))

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", v double"
    return sent.withColumn("_own", own).groupBy(*by, "_ti", "_tj").applyInPandas(each, schema)


def conv2d(img: DataFrame, by: list[str], shape: tuple[int, int], kernel: list[list[float]], boundary: str = "periodic") -> DataFrame:
    """Convolution with a small kernel given as rows over i of columns over j, centred; missing cells are left out."""
    k = np.asarray(kernel, float)
    reach = (k.shape[0] // 2, k.shape[1] // 2)
    whole = np.zeros((2 * reach[0] + 1, 2 * reach[1] + 1))
    whole[: k.shape[0], : k.shape[1]] = k
    flipped = whole[::-1, ::-1]

    def of(windows: np.ndarray) -> np.ndarray:
        some = ~np.isnan(windows).all(axis=(2, 3))
        return np.where(some, np.einsum("abij,ij->ab", np.nan_to_num(windows, posinf=np.inf, neginf=-np.inf), flipped), np.nan)

    return _tiled(img, by, shape, reach, boundary, of)


def _quiet(f: Callable[..., np.ndarray], windows: np.ndarray) -> np.ndarray:
    with warnings.catch_warnings():  # windows without a cell give NaN
        warnings.simplefilter("ignore", RuntimeWarning)
        return f(windows.reshape(*windows.shape[:2], -1), axis=2)


def med2d(img: DataFrame, by: list[str], shape: tuple[int, int], height: int, width: int, boundary: str = "periodic") -> DataFrame:
    """Median over an odd box around each cell, missing cells left out."""
    return _tiled(img, by, shape, (height // 2, width // 2), boundary, lambda w: _quiet(np.nanmedian, w))


def med2df(img: DataFrame, by: list[str], shape: tuple[int, int], height: int, width: int, boundary: str = "periodic") -> DataFrame:
    """Median over all cells of an odd box: ``med2d``, which has no other kind of window."""
    return med2d(img, by, shape, height, width, boundary)


def box2d(img: DataFrame, by: list[str], shape: tuple[int, int], wi: int, wj: int, edgezero: bool = False) -> DataFrame:
    """Moving mean over an odd box, absent and missing cells counting as 0; cells nearer to an edge than half a box
    are kept, or zero."""
    hi, hj = wi // 2, wj // 2
    inside = F.col("i").between(hi, shape[0] - 1 - hi) & F.col("j").between(hj, shape[1] - 1 - hj)
    means = _tiled(img, by, shape, (hi, hj), "truncate", lambda w: np.nansum(w, axis=(2, 3)) / (wi * wj)).withColumnRenamed("v", "_m")
    both = ranged.same_keys(img, means, [*by, "i", "j"], "left")
    return both.select(*by, "i", "j", F.when(inside, F.col("_m")).otherwise(F.lit(0.0) if edgezero else F.col("v")).alias("v"))


def patch2d(img: DataFrame, by: list[str], shape: tuple[int, int], bad: str | None = None) -> DataFrame:
    """Cells flagged by ``bad`` (missing ones without) become the mean of their good neighbours, if any."""
    flag = F.coalesce(F.col(bad) != 0, F.lit(False)) if bad else F.col("v").isNull()
    good = img.select(*by, "i", "j", F.when(~flag, F.col("v")).alias("v"))
    means = _tiled(good, by, shape, (1, 1), "truncate", lambda w: _quiet(np.nanmean, w)).withColumnRenamed("v", "_m")
    marked = img.withColumn("_bad", flag)
    return ranged.same_keys(marked, means, [*by, "i", "j"], "left").select(*by, "i", "j", F.when(F.col("_bad"), F.coalesce("_m", "v")).otherwise(F.col("v")).alias("v"))


def max2d_ind(img: DataFrame, by: list[str]) -> DataFrame:
    best = F.max(F.struct(F.col("v"), (-F.col("j")).alias("nj"), (-F.col("i")).alias("ni")))
    return img.where("v is not null").groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.v").alias("v"), (-F.col("b.ni")).alias("i"), (-F.col("b.nj")).alias("j"))


def centroid2d(img: DataFrame, by: list[str], ci: float, cj: float, box: float) -> DataFrame:
    near = img.where((F.abs(F.col("i") - ci) <= box / 2) & (F.abs(F.col("j") - cj) <= box / 2))
    return near.groupBy(*by).agg((F.sum(F.col("i") * F.col("v")) / F.sum("v")).alias("ci"), (F.sum(F.col("j") * F.col("v")) / F.sum("v")).alias("cj"))


def crop(img: DataFrame, by: list[str]) -> DataFrame:
    hit = img.where(F.coalesce(F.col("v") != 0, F.lit(False)))
    return hit.groupBy(*by).agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


def label_components(img: DataFrame, shape: tuple[int, int], connectivity: int = 8) -> DataFrame:
    """Cells of a mask with the number, from 1, of their connected component; 0 outside the mask."""
    on = img.where(F.coalesce(F.col("v") != 0, F.lit(False))).select("i", "j", (F.col("i") * shape[1] + F.col("j")).cast("long").alias("id"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    other = on.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("id").alias("dst"))
    sent = on.select(F.col("id").alias("src"), F.explode(F.array(*[F.struct((F.col("i") + a).alias("_i"), (F.col("j") + b).alias("_j")) for a, b in steps])).alias("t")).select("src", "t.*")
    found = connected_components(sent.join(other, ["_i", "_j"]).select("src", "dst"))
    rooted = on.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("i", "j", F.coalesce("component", "id").alias("root"))
    roots = ranged.indexed(rooted.select("root").distinct(), ["root"], "nth").select("root", (F.col("nth") + 1).alias("label"))
    labelled = rooted.join(roots, "root").select("i", "j", "label")
    return img.select("i", "j").join(labelled, ["i", "j"], "left").select("i", "j", F.coalesce("label", F.lit(0)).alias("label"))


def pnpoly(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """1 for points inside a polygon, by the parity of crossings."""
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if ya != yb:
            crosses = ((F.lit(ya) > y) != (F.lit(yb) > y)) & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
            crossings = crossings + crosses.cast("int")
    return crossings % 2


def polyfill(img: DataFrame, polygon: list[tuple[float, float]], colour: float) -> DataFrame:
    return img.withColumn("v", F.when(pnpoly(F.col("i"), F.col("j"), polygon) == 1, F.lit(colour)).otherwise(F.col("v")))


def rebin(img: DataFrame, by: list[str], factor_i: int, factor_j: int, norm: bool = False) -> DataFrame:
    """Blocks of cells averaged (summed with ``norm``)."""
    keys = [F.floor(F.col("i") / factor_i).alias("i"), F.floor(F.col("j") / factor_j).alias("j")]
    return img.groupBy(*by, *keys).agg((F.sum("v") if norm else F.avg("v")).alias("v"))


def circ_mean(img: DataFrame, ci: float, cj: float) -> DataFrame:
    """Mean over rings of equal truncated radius."""
    r = F.floor(F.sqrt((F.col("i") - ci) * (F.col("i") - ci) + (F.col("j") - cj) * (F.col("j") - cj)))
    return img.groupBy(r.alias("r")).agg(F.avg("v").alias("v"))


def _sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))


def _soft_box(x: Column) -> Column:
    """Transform of a box whose edges are hyperbolic tangents: a sinc that the width of the edges damps."""
    y = x * (math.pi**2 / TANH_STEEPNESS)
    return _sinc(x) * F.when(y == 0, 1.0).otherwise(y / F.sinh(y))


# The tangents' steepness, the share of a raised cosine's foot, and the steps of a cell in which kernels are tabulated.
TANH_STEEPNESS, HANN, HAMMING, STEPS = 5.0, 0.5, 0.54, 1000
# Kernels over the two cells on each side of a place, by the distance from it.
KERNELS: dict[str, Callable[[Column], Column]] = {
    "tanh": _soft_box,
    "sinc": _sinc,
    "sinc2": lambda x: _sinc(x) * _sinc(x),
    "lanczos": lambda x: F.when(F.abs(x) < 2, _sinc(x) * _sinc(x / 2)).otherwise(0.0),
    "hann": lambda x: F.when(F.abs(x) < 1, HANN + (1 - HANN) * F.cos(math.pi * x)).otherwise(0.0),
    "hamming": lambda x: F.when(F.abs(x) < 1, HAMMING + (1 - HAMMING) * F.cos(math.pi * x)).otherwise(0.0),
}


def warp2d_kernel(spark: SparkSession, name: str) -> DataFrame:
    """``(x, k)``: a kernel of ``warp2d`` at every step from 0 to two cells away, its weights as they are before they are made to sum to 1."""
    x = (F.col("id") / STEPS).alias("x")
    return spark.range(2 * STEPS + 1).select(x).select("x", KERNELS[name](F.col("x")).alias("k"))


def _taps(part: Column, method: str) -> tuple[list[int], Column]:
    """Offsets from the cell below a place and an array of their weights, for the part of a cell that is left."""
    if method == "linear":
        return [0, 1], F.array(1 - part, part)
    if method == "cubic":  # slopes are half the differences of the cells on both sides
        s, u = part * part, part * part * part
        return [-1, 0, 1, 2], F.array(s - (part + u) / 2, 1 - 2.5 * s + 1.5 * u, part / 2 + 2 * s - 1.5 * u, (u - s) / 2)
    offsets = [-1, 0, 1, 2]
    step = F.floor(part * STEPS) / STEPS
    weights = F.array(*[KERNELS[method](step - k) for k in offsets])
    total = F.aggregate(weights, F.lit(0.0), lambda x, y: x + y)
    return offsets, F.transform(weights, lambda w: w / total)


def interp_nd(cells: DataFrame, dims: list[str], shape: list[int], target: DataFrame, at: list[Column], method: str = "linear", boundary: str = "truncate") -> DataFrame:
    """Values of an array ``(dims..., v)`` at places given for each row of ``target``.

    ``method`` is "sample" (the nearest cell), "linear" (over the 2^n cells around), "cubic" or one of KERNELS (over 4^n).
    """
    # rows that are repeated are asked for once and repeated in the end
    once = target.groupBy(*target.columns).agg(F.count("*").cast("int").alias("_times"))
    place = [f"_a{n}" for n in range(len(dims))]
    held = once.withColumns({p: c.cast("double") for p, c in zip(place, at, strict=True)}).withColumn("_id", F.struct(*[F.col(c) for c in target.columns]))
    keys = [f"_i{n}" for n in range(len(dims))]
    source = cells.select(*[F.col(d).cast("long").alias(k) for d, k in zip(dims, keys, strict=True)], F.col("v").cast("double").alias("_v"))
    if method == "sample":
        corners = F.array(F.struct(*[F.floor(F.col(p) + 0.5).alias(f"i{n}") for n, p in enumerate(place)], F.lit(1.0).alias("w")))
    else:
        low = [F.floor(p) for p in place]
        taps = [_taps(F.col(p) - f, method) for p, f in zip(place, low, strict=True)]
        held = held.withColumns({f"_w{n}": w for n, (_, w) in enumerate(taps)})
        weight = lambda at: fold(lambda x, y: x * y, [F.col(f"_w{n}")[k] for n, k in enumerate(at)])
        every = product(*[range(len(offsets)) for offsets, _ in taps])
        corners = F.array(*[F.struct(*[(f + taps[n][0][k]).alias(f"i{n}") for n, (f, k) in enumerate(zip(low, at, strict=True))], weight(at).alias("w")) for at in every])
        corners = F.filter(corners, lambda c: c["w"] != 0)
    # a place with a missing part has no value, but its row stays
    known = fold(lambda x, y: x & y, [F.col(p).isNotNull() for p in place])
    asked = held.select("_id", "_times", known.alias("_known"), F.explode_outer(F.when(known, corners)).alias("c"))
    asked = asked.select("_id", "_times", "_known", F.col("c.w").alias("_w"), *[_edge(F.col(f"c.i{n}"), size, boundary).cast("long").alias(k) for n, (k, size) in enumerate(zip(keys, shape, strict=True))])
    sums = asked.join(source, keys, "left").groupBy("_id", "_times", "_known").agg(F.sum(F.coalesce("_v", F.lit(0.0)) * F.col("_w")).alias("value"))
    return sums.select("_id", F.when(F.col("_known"), F.col("value")).alias("value"), F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select("_id.*", "value")


def resample(img: DataFrame, shape: tuple[int, int], target: DataFrame, at_i: Column, at_j: Column, method: str = "linear", boundary: str = "truncate") -> DataFrame:
    """Values of the image at places given for each row of ``target``, by the methods of ``interp_nd``."""
    return interp_nd(img, ["i", "j"], list(shape), target, [at_i, at_j], method, boundary)


def rot2d(img: DataFrame, shape: tuple[int, int], degrees: float, method: str = "linear") -> DataFrame:
    """Rotation about the middle, by looking up where each cell comes from."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    mi, mj = (shape[0] - 1) / 2, (shape[1] - 1) / 2
    x, y = F.col("i") - mi, F.col("j") - mj
    moved = resample(img, shape, img.select("i", "j"), x * float(c) + y * float(s) + mi, y * float(c) - x * float(s) + mj, method)
    return moved.withColumnRenamed("value", "v")


def rotnewsz(shape: tuple[int, int], degrees: float) -> tuple[int, int]:
    """Size of the smallest image that holds another one turned."""
    c, s = abs(math.cos(math.radians(degrees))), abs(math.sin(math.radians(degrees)))
    return math.ceil(shape[0] * c + shape[1] * s - 1e-9), math.ceil(shape[1] * c + shape[0] * s - 1e-9)


def warp2d(img: DataFrame, shape: tuple[int, int], fit: dict[str, list[float]], degree: int, method: str = "linear", noval: float = 0.0) -> DataFrame:
    """The image seen through a polynomial warp: each cell shows what lies where the fit sends its place.

    With a method of KERNELS a cell whose 4 x 4 surroundings are not all within the image is ``noval``.
    """
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    x, y = warp_columns(i, j, fit["x"], degree), warp_columns(i, j, fit["y"], degree)
    moved = resample(img, shape, img.select("i", "j"), x, y, method).withColumnRenamed("value", "v")
    if method not in KERNELS:
        return moved
    within = F.floor(x).between(1, shape[0] - 3) & F.floor(y).between(1, shape[1] - 3)
    return moved.withColumn("v", F.when(within, F.col("v")).otherwise(F.lit(noval)))


def fitwarp2d(pairs: DataFrame, x: str, y: str, u: str, v: str, degree: int) -> dict[str, list[float]]:
    """Least-squares polynomial coefficients of x and y in powers of (u, v): the normal equations are one
    distributed aggregate of at most degree^4 sums, solved on the driver."""
    powers = [(a, b) for b in range(degree) for a in range(degree)]
    basis = [F.pow(F.col(u), F.lit(a)) * F.pow(F.col(v), F.lit(b)) for a, b in powers]
    n = len(basis)
    row = pairs.agg(*[F.sum(basis[p] * basis[q]) for p in range(n) for q in range(n)], *[F.sum(b * F.col(c)) for c in (x, y) for b in basis]).first()
    left = np.array(row[: n * n], float).reshape(n, n)
    return {c: np.linalg.lstsq(left, np.array(row[n * n + k * n : n * n + (k + 1) * n], float), rcond=None)[0].tolist() for k, c in enumerate((x, y))}


def warp_columns(u: Column, v: Column, coefficients: list[float], degree: int) -> Column:
    out = F.lit(0.0)
    for k, c in enumerate(coefficients):
        out = out + F.lit(c) * F.pow(u, F.lit(k % degree)) * F.pow(v, F.lit(k // degree))
    return out

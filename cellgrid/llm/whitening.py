"""Whitening of embeddings by matrix-free block subspace iteration.

The covariance V is never formed: one Spark pass sums X'(XQ) over centred rows for a block Q of directions,
and the driver, which holds nothing longer than the block, orthonormalises it (QR) and turns it to Ritz
vectors.  Passes end when the residual of every wanted component certifies it against the gaps beside it.
A block that comes near too slowly is widened, at most to the vectors' length, where it is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.plans.shared import materialize

# Entries are held as whole numbers floor(SCALE * entry) + SHIFT, so that sums over any number of rows are exact.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# An eigenvector is certified if its residual is below this share of the gap to the next eigenvalue, or at rounding.
TOLERANCE = 1e-13
# Widen the block unless the residuals' fall so far will do within this many further passes.
PATIENCE = 4
MAX_PASSES = 200
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """What a fit found: rows, exact sums, eigenvalues (falling), unit eigenvectors as columns, the covariance's trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int

    @property
    def has_variance(self) -> np.ndarray:
        """Components that can be scaled to unit variance; of fewer distinct rows than dimensions the last ones can't."""
        return self.values > len(self.sums) * EPS * max(self.values, default=0.0)

    @property
    def scaled(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; 0 without variance."""
        return self.vectors * np.where(self.has_variance, 1 / np.sqrt(np.where(self.has_variance, self.values, 1.0)), 0.0)


def fixed_point(vector: Column) -> Column:
    """Entries as whole numbers; null for a null vector and for one that holds a null or non-finite entry."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return F.when(~odd, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exactly."""
    return x * n - sums


def sums_of_squares(c: np.ndarray) -> np.ndarray:
    """Sum of squares of each row of whole numbers, exactly; an error only where a sum itself is beyond a long."""
    most = int(np.abs(c).max(initial=0))
    if most**2 >= 2**63:
        raise OverflowError("a deviation is beyond a long")
    squares = c * c
    if most**2 * c.shape[1] >= 2**63:  # sums may be: the upper 31 bits and the lower 32 are added up apart
        high = (squares >> 32).sum(axis=1) + ((squares & 0xFFFFFFFF).sum(axis=1) >> 32)
        if (high >= 2**31).any():
            raise OverflowError("a deviation is beyond a long")
    return squares.sum(axis=1)


def summed(parts: DataFrame) -> np.ndarray:
    """Sum over all rows of the packed column ``y``: places are added up by Spark, one row of each reaches the driver."""
    got = parts.select(F.posexplode("y").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["at"]] = r["v"]
    return out


def per_task(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``of(batch of x)`` over all batches; every task sends one array."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                one = of(np.stack(b["x"].to_numpy()))
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"y": [total.ravel()]})

    return summed(rows.select("x").mapInPandas(partial, "y array<double>"))


def subspace(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues and their vectors of the symmetric positive d x d operator, and the passes taken.

    ``multiply`` is called once a pass with an orthonormal block.  A residual r bounds the angle to the true
    vector by r over the gap, so a component is certified when r is TOLERANCE of the gap, or is rounding.
    """
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, min(d, 2 * k))))[0]
    before = math.inf
    for done in range(1, MAX_PASSES + 1):
        y = multiply(q)
        t = q.T @ y
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        residual = np.linalg.norm(image - ritz * values, axis=0)[:k]
        near = np.abs(values[:, None] - values[None, :]) + np.diag(np.full(len(values), math.inf))
        rounding = 16 * EPS * math.sqrt(d) * max(values[0], 0.0)
        allowed = np.maximum(TOLERANCE * near.min(axis=1)[:k], rounding)
        if (residual <= allowed).all():
            return values[:k], ritz[:, :k], done
        worst = float((residual / np.maximum(allowed, 1e-300)).max())
        slow = worst * (worst / before) ** PATIENCE > 1 if math.isfinite(before) else False
        before = worst
        q = image
        if slow and q.shape[1] < d:
            q = np.hstack([q, rng.standard_normal((d, min(q.shape[1], d - q.shape[1])))])
            before = math.inf
        q = np.linalg.qr(q)[0]
    raise RuntimeError(f"{k} components were not certified in {MAX_PASSES} passes")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of rows with whole-number vectors in ``x``, all of one length; None for an empty table.

    Row count and sums are exact.  What reaches the driver is a block: the vectors' length times its width.
    """
    n, least, most = rows.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if not n:
        return None
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} entries")
    places = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.max(F.abs("v")).alias("m")).collect()
    sums = np.zeros(most, np.int64)
    for r in places:
        sums[r["at"]] = r["s"]
    if 2 * n * max((r["m"] for r in places), default=0) >= 2**63:
        raise OverflowError("rows times the largest entry are beyond a long")
    trace = float(per_task(rows, lambda x: np.atleast_1d(np.square(centred(x, n, sums) / n).sum())).sum()) / n

    def multiply(q: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums) / n
            return c.T @ (c @ q)

        return per_task(rows, product).reshape(q.shape) / n

    k = min(components, most)
    values, vectors, passes = subspace(multiply, most, k) if k else (np.zeros(0), np.zeros((0, 0)), 0)
    return Whitening(n, sums, np.maximum(values, 0.0), vectors, trace, passes)


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, by a pass over all rows."""
    n, sums, turn = w.n, w.sums, w.scaled[:, w.has_variance]
    k = turn.shape[1]
    if not k:
        return 0.0

    def moments(x: np.ndarray) -> np.ndarray:
        z = (centred(x, n, sums) / n) @ turn
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    got = per_task(rows, moments) / n
    mean, square = got[:k], got[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def projected(x: Column, w: Whitening) -> Column:
    """Struct of a vector's ``deviation``, the exact sum of (n * x - sums) squared, and its ``whitened`` components."""
    n, sums, turn = w.n, w.sums, w.scaled

    @F.pandas_udf("deviation long, whitened array<double>")
    def of(xs: pd.Series) -> pd.DataFrame:
        c = centred(np.stack(xs.to_numpy()), n, sums) if len(xs) else np.zeros((0, len(sums)), np.int64)
        return pd.DataFrame({"deviation": sums_of_squares(c), "whitened": list((c / n) @ turn)})

    return of(x)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows ``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each good row and component.

    Rows whose vector is null, or holds null or non-finite entries, are left out; repeated rows and null ids
    count and stay.  Components are numbered from 1 by falling variance.  One without variance, as where there
    are fewer distinct rows than components, is null in ``whitened``.  Vectors of several lengths are an error,
    as are sums beyond a long.  An empty table gives no rows; other columns are ignored.
    """
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), fixed_point(F.col(vector_col)).alias("x"))
    rows = materialize(rows.where(F.col("x").isNotNull()), "fixed-point")
    w = fit(rows, components)
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], shape)
    error = identity_error(rows, w)
    share = [float(v / w.trace) if w.trace else None for v in w.values]
    about = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(bool(ok)).alias("ok"), F.lit(s).cast("double").alias("explained")) for i, (ok, s) in enumerate(zip(w.has_variance, share, strict=True))])
    each = rows.select("vec_id", projected(F.col("x"), w).alias("p")).select("vec_id", "p.deviation", F.explode(F.arrays_zip(about.alias("about"), F.col("p.whitened").alias("z"))).alias("c"))
    return each.select("vec_id", "c.about.component", F.lit(w.n).cast("long").alias("n"), "deviation", F.when(F.col("c.about.ok"), F.col("c.z")).alias("whitened"), F.col("c.about.explained").alias("explained"), F.lit(error).alias("identity_error"))

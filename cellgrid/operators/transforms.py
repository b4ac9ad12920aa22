"""Coordinate transforms as functions from coordinate columns to coordinate columns, and map projections.

A transform has a forward map and, where there is one, an inverse; they compose with ``@`` and invert with ``~``.
Projections take longitude and latitude in radians.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Map = Callable[..., tuple[Column, ...]]


@dataclass(frozen=True)
class Transform:
    forward: Map
    inverse: Map | None = None
    name: str = "transform"

    def apply(self, *coordinates: Column) -> tuple[Column, ...]:
        return self.forward(*coordinates)

    def invert(self, *coordinates: Column) -> tuple[Column, ...]:
        if self.inverse is None:
            raise ValueError(f"{self.name} has no inverse")
        return self.inverse(*coordinates)

    def __invert__(self) -> Transform:
        return Transform(self.invert, self.forward, f"~{self.name}")

    def __matmul__(self, first: Transform) -> Transform:
        """self after ``first``."""
        return Transform(lambda *c: self.apply(*first.apply(*c)), lambda *c: first.invert(*self.invert(*c)), f"{self.name} @ {first.name}")

    def __pow__(self, n: int) -> Transform:
        out, step = t_identity(), self if n >= 0 else ~self
        for _ in range(abs(n)):
            out = step @ out
        return out


def t_identity() -> Transform:
    return Transform(lambda *c: c, lambda *c: c, "identity")


def t_code(forward: Map, inverse: Map | None = None) -> Transform:
    return Transform(forward, inverse, "code")


def t_linear(matrix: list[list[float]] | None = None, pre: list[float] | None = None, post: list[float] | None = None, scale: float | list[float] = 1.0, rot: float = 0.0) -> Transform:
    """post + M (c + pre), where M is the matrix, or a rotation in degrees times a scale in two dimensions."""
    if matrix is None:
        n = len(pre or post or (scale if isinstance(scale, list) else [0, 0]))
        m = np.eye(n)
        if rot:
            c, s = math.cos(math.radians(rot)), math.sin(math.radians(rot))
            m[:2, :2] = [[c, -s], [s, c]]
        m = np.diag(np.broadcast_to(np.asarray(scale, float), n)) @ m
    else:
        m = np.asarray(matrix, float)
    n = len(m)
    before, after = pre or [0.0] * n, post or [0.0] * n
    back = np.linalg.inv(m)

    def times(a: np.ndarray, c: tuple, add: list[float], then: list[float]) -> tuple[Column, ...]:
        moved = [x + d for x, d in zip(c, add, strict=True)]
        return tuple(sum((x * float(w) for x, w in zip(moved, row, strict=True)), F.lit(0.0)) + t for row, t in zip(a, then, strict=True))

    return Transform(lambda *c: times(m, c, before, after), lambda *c: times(back, c, [-x for x in after], [-x for x in before]), "linear")


def t_scale(scale: float | list[float], n: int = 2) -> Transform:
    return t_linear(scale=scale if isinstance(scale, list) else [scale] * n)


def t_offset(offset: list[float]) -> Transform:
    return t_linear(post=offset)


def t_rot(degrees: float) -> Transform:
    return t_linear(rot=degrees)


def t_fits(header: dict[str, float], n: int = 2) -> Transform:
    """Pixel (from 0) to science coordinates by CRPIX, CRVAL, CDELT and CROTA2 or a CD matrix."""
    if "CD1_1" in header:
        m = [[header.get(f"CD{i}_{j}", 0.0) for j in range(1, n + 1)] for i in range(1, n + 1)]
    else:
        m = np.diag([header.get(f"CDELT{i}", 1.0) for i in range(1, n + 1)])
        if r := header.get(f"CROTA{n}", 0.0):
            c, s = math.cos(math.radians(r)), math.sin(math.radians(r))
            m[:2, :2] = np.array([[c, -s], [s, c]]) @ m[:2, :2]
        m = m.tolist()
    return t_linear(matrix=m, pre=[1 - header.get(f"CRPIX{i}", 1.0) for i in range(1, n + 1)], post=[float(header.get(f"CRVAL{i}", 0.0)) for i in range(1, n + 1)])


def t_radial(origin: tuple[float, float] = (0.0, 0.0)) -> Transform:
    """(x, y) to (angle in 0..2 pi, radius)."""
    ox, oy = origin
    turn = 2 * math.pi
    return Transform(lambda x, y: (F.pmod(F.atan2(y - oy, x - ox) + turn, F.lit(turn)), F.hypot(x - ox, y - oy)), lambda t, r: (r * F.cos(t) + ox, r * F.sin(t) + oy), "radial")


def t_quadratic(strength: float = 0.1, size: float = 1.0) -> Transform:
    """x + a x |x| scaled to leave the size in place, per coordinate."""

    def there(*c: Column) -> tuple[Column, ...]:
        return tuple((x + strength * x * F.abs(x) / size) / (abs(strength) + 1) for x in c)

    def back(*c: Column) -> tuple[Column, ...]:
        k = abs(strength) + 1
        return tuple(F.signum(y) * size * (F.sqrt(1 + 4 * abs(strength) * k * F.abs(y) / size) - 1) / (2 * abs(strength)) for y in c)

    return Transform(there, back if strength > 0 else None, "quadratic")


def t_spherical() -> Transform:
    """(x, y, z) to (longitude, latitude, radius)."""

    def there(x: Column, y: Column, z: Column) -> tuple[Column, ...]:
        r = F.sqrt(x * x + y * y + z * z)
        return F.atan2(y, x), F.when(r > 0, F.asin(z / F.when(r > 0, r))).otherwise(0.0), r

    return Transform(there, lambda t, p, r: (r * F.cos(p) * F.cos(t), r * F.cos(p) * F.sin(t), r * F.sin(p)), "spherical")


def t_unit_sphere() -> Transform:
    return Transform(lambda lon, lat: (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)), lambda x, y, z: (F.atan2(y, x), F.atan2(z, F.hypot(x, y))), "unit sphere")


def t_rot_sphere(lon0: float, lat0: float) -> Transform:
    """Turns the sphere so that (lon0, lat0) becomes the origin."""
    c, s = math.cos(lat0), math.sin(lat0)
    sphere = t_unit_sphere()

    def there(lon: Column, lat: Column) -> tuple[Column, ...]:
        x, y, z = sphere.apply(lon - lon0, lat)
        return sphere.invert(c * x + s * z, y, c * z - s * x)

    def back(lon: Column, lat: Column) -> tuple[Column, ...]:
        x, y, z = sphere.apply(lon, lat)
        a, b = sphere.invert(c * x - s * z, y, s * x + c * z)
        return a + lon0, b

    return Transform(there, back, "rotated sphere")


def t_carree() -> Transform:
    return Transform(lambda lon, lat: (lon, lat), lambda x, y: (x, y), "plate carree")


def t_mercator() -> Transform:
    return Transform(lambda lon, lat: (lon, F.asinh(F.tan(lat))), lambda x, y: (x, F.atan(F.sinh(y))), "mercator")


def t_sin_lat() -> Transform:
    return Transform(lambda lon, lat: (lon, F.sin(lat)), lambda x, y: (x, F.asin(y)), "sine latitude")


def t_sinusoidal() -> Transform:
    return Transform(lambda lon, lat: (lon * F.cos(lat), lat), lambda x, y: (x / F.cos(y), y), "sinusoidal")


def _azimuthal(name: str, radius: Callable[[Column], Column], angle: Callable[[Column], Column]) -> Transform:
    """Projections about the origin of the sphere whose radius depends on the angular distance only."""

    def there(lon: Column, lat: Column) -> tuple[Column, ...]:
        x, y, z = t_unit_sphere().apply(lon, lat)
        flat = F.hypot(y, z)
        k = F.when(flat > 0, radius(F.atan2(flat, x)) / F.when(flat > 0, flat)).otherwise(1.0)
        return y * k, z * k

    def back(x: Column, y: Column) -> tuple[Column, ...]:
        r = F.hypot(x, y)
        c = angle(r)
        k = F.when(r > 0, F.sin(c) / F.when(r > 0, r)).otherwise(1.0)
        return t_unit_sphere().invert(F.cos(c), x * k, y * k)

    return Transform(there, back, name)


def t_orthographic() -> Transform:
    return _azimuthal("orthographic", F.sin, F.asin)


def t_stereographic() -> Transform:
    return _azimuthal("stereographic", lambda c: 2 * F.tan(c / 2), lambda r: 2 * F.atan(r / 2))


def t_gnomonic() -> Transform:
    return _azimuthal("gnomonic", F.tan, F.atan)


def t_az_eqd() -> Transform:
    return _azimuthal("equidistant", lambda c: c, lambda r: r)


def t_az_eqa() -> Transform:
    return _azimuthal("equal area", lambda c: 2 * F.sin(c / 2), lambda r: 2 * F.asin(r / 2))


def t_vertical(distance: float) -> Transform:
    """Perspective from ``distance`` radii above the centre; forward only beyond the horizon too."""
    return Transform(lambda lon, lat: tuple(v * (distance - 1) / (distance - t_unit_sphere().apply(lon, lat)[0]) for v in t_unit_sphere().apply(lon, lat)[1:]), None, "vertical")


def t_hammer() -> Transform:
    def there(lon: Column, lat: Column) -> tuple[Column, ...]:
        k = F.sqrt(2 / (1 + F.cos(lat) * F.cos(lon / 2)))
        return 2 * k * F.cos(lat) * F.sin(lon / 2), k * F.sin(lat)

    def back(x: Column, y: Column) -> tuple[Column, ...]:
        z = F.sqrt(1 - x * x / 16 - y * y / 4)
        return 2 * F.atan2(z * x, 2 * (2 * z * z - 1)), F.asin(z * y)

    return Transform(there, back, "hammer")


def _conic(name: str, n: float, rho: Callable[[Column], Column], lat_of: Callable[[Column], Column], rho0: float) -> Transform:
    sign = math.copysign(1.0, n)

    def back(x: Column, y: Column) -> tuple[Column, ...]:
        return F.atan2(sign * x, sign * (rho0 - y)) / n, lat_of(sign * F.hypot(x, rho0 - y))

    return Transform(lambda lon, lat: (rho(lat) * F.sin(n * lon), rho0 - rho(lat) * F.cos(n * lon)), back, name)


def t_conic(lat1: float, lat2: float) -> Transform:
    """Equidistant conic."""
    n = math.sin(lat1) if lat1 == lat2 else (math.cos(lat1) - math.cos(lat2)) / (lat2 - lat1)
    g = math.cos(lat1) / n + lat1
    return _conic("conic", n, lambda lat: g - lat, lambda r: g - r, g)


def t_albers(lat1: float, lat2: float) -> Transform:
    n = (math.sin(lat1) + math.sin(lat2)) / 2
    c = math.cos(lat1) ** 2 + 2 * n * math.sin(lat1)
    return _conic("albers", n, lambda lat: F.sqrt(c - 2 * n * F.sin(lat)) / n, lambda r: F.asin((c - r * r * n * n) / (2 * n)), math.sqrt(c) / n)


def t_lambert(lat1: float, lat2: float) -> Transform:
    """Conformal conic."""
    up = lambda a: math.tan(math.pi / 4 + a / 2)
    n = math.sin(lat1) if lat1 == lat2 else math.log(math.cos(lat1) / math.cos(lat2)) / math.log(up(lat2) / up(lat1))
    f = math.cos(lat1) * up(lat1) ** n / n
    return _conic("lambert", n, lambda lat: f / F.pow(F.tan(math.pi / 4 + lat / 2), F.lit(n)), lambda r: 2 * F.atan(F.pow(f / r, F.lit(1 / n))) - math.pi / 2, f)

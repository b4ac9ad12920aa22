"""Elementwise arithmetic, comparison, missing-value and scalar functions as Spark columns.

A missing cell is NULL and any missing operand makes the result missing.  Masks are 0/1 integers.
Comparisons follow IEEE: NaN compares false, even with itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
# Byte luma weights over 256.
LUMA = (77, 150, 29)


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _nan(*xs: Column) -> Column:
    return F.coalesce(F.greatest(*[F.isnan(x.cast("double")) for x in xs], F.lit(False)), F.lit(False))


def _known(value: Column, *xs: Column) -> Column:
    """value where all of xs are present, else null."""
    ok = F.lit(True)
    for x in xs:
        ok = ok & x.isNotNull()
    return F.when(ok, value)


def wrap_cast(x: Column | str, dtype: str) -> Column:
    """Cast as C does: toward zero, wrapping at the type's width; unsigned types live in the next wider one.

    What is no finite number is missing in a whole type.
    """
    if dtype not in ("float", "double", "ldouble"):
        size = F.abs(_c(x).cast("double"))
        x = F.when(~F.isnan(size) & (size != F.lit(math.inf)), _c(x))
    c = F.floor(F.abs(_c(x).cast("double"))) * F.signum(_c(x).cast("double"))
    unsigned = {"byte": (8, "smallint"), "ushort": (16, "int"), "ulong": (32, "bigint")}
    signed = {"sbyte": (8, "tinyint"), "short": (16, "smallint"), "long": (32, "int")}
    if dtype in unsigned:
        bits, to = unsigned[dtype]
        return F.pmod(c, F.lit(float(1 << bits))).cast(to)
    if dtype in signed:
        bits, to = signed[dtype]
        half = float(1 << bits - 1)
        return (F.pmod(c + half, F.lit(2 * half)) - half).cast(to)
    return _c(x).cast({"float": "float", "double": "double", "ldouble": "double", "longlong": "bigint", "indx": "bigint", "ulonglong": "decimal(20,0)"}[dtype])


def plus(a, b) -> Column:
    return _c(a) + _c(b)


def minus(a, b) -> Column:
    return _c(a) - _c(b)


def mult(a, b) -> Column:
    return _c(a) * _c(b)


def divide(a, b) -> Column:
    """Floating division: x/0 is infinite or NaN, not an error."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    by_zero = F.when(_nan(a) | (a == 0), float("nan")).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, _known(by_zero, a)).otherwise(F.try_divide(a, b))


def int_divide(a, b) -> Column:
    """Integer division toward zero; a zero divisor gives a missing cell."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    q = F.try_divide(F.abs(a) - F.try_mod(F.abs(a), F.abs(b)), F.abs(b)).cast("bigint")
    return F.when((a < 0) != (b < 0), -q).otherwise(q)


def modulo(a, b) -> Column:
    """Remainder with the divisor's sign; 0 for a zero divisor."""
    a, b = _c(a), _c(b)
    m = F.try_mod(a, b)
    return F.when(b == 0, _known(a * 0, a)).when((m != 0) & ((m < 0) != (b < 0)), m + b).otherwise(m)


def power(a, b) -> Column:
    return F.pow(_c(a), _c(b))


def ipow(a, b) -> Column:
    """Exact integer power by repeated multiplication, for counts from 0."""
    a, b = _c(a).cast("bigint"), _c(b).cast("int")
    return _known(F.aggregate(F.array_repeat(a, b), F.lit(1).cast("bigint"), lambda s, x: s * x), a, b)


def _compare(op: str, a, b) -> Column:
    a, b = _c(a), _c(b)
    c = {"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b, "eq": a == b}[op]
    return _known((c & ~_nan(a, b)).cast("int"), a, b)


def gt(a, b) -> Column:
    return _compare("gt", a, b)


def lt(a, b) -> Column:
    return _compare("lt", a, b)


def ge(a, b) -> Column:
    return _compare("ge", a, b)


def le(a, b) -> Column:
    return _compare("le", a, b)


def eq(a, b) -> Column:
    return _compare("eq", a, b)


def ne(a, b) -> Column:
    return 1 - eq(a, b)


def spaceship(a, b) -> Column:
    """-1, 0 or 1; anything neither less nor equal, NaN included, is 1."""
    a, b = _c(a), _c(b)
    return _known(F.when(_nan(a, b), 1).when(a < b, -1).when(a == b, 0).otherwise(1), a, b)


def shiftleft(a, b) -> Column:
    return F.call_function("shiftleft", _c(a), _c(b).cast("int"))


def shiftright(a, b) -> Column:
    return F.call_function("shiftright", _c(a), _c(b).cast("int"))


def and2(a, b) -> Column:
    return _c(a).bitwiseAND(_c(b))


def or2(a, b) -> Column:
    return _c(a).bitwiseOR(_c(b))


def xor2(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def bitnot(a) -> Column:
    return F.bitwise_not(_c(a))


def logical_not(a) -> Column:
    return (_c(a) == 0).cast("int")


def log(a) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    a = _c(a).cast("double")
    return F.when(a == 0, -INF).when(_nan(a) | (a < 0), _known(F.lit(float("nan")), a)).otherwise(F.ln(a))


def log10(a) -> Column:
    a = _c(a).cast("double")
    return F.when(a == 0, -INF).when(_nan(a) | (a < 0), _known(F.lit(float("nan")), a)).otherwise(F.log10(a))


def sqrt(a) -> Column:
    return F.sqrt(_c(a))


def exp(a) -> Column:
    return F.exp(_c(a))


def rint(a) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(_c(a))


def abs2(a) -> Column:
    return _c(a) * _c(a)


def hclip(a, high) -> Column:
    return _known(F.least(_c(a), _c(high)), _c(a), _c(high))


def lclip(a, low) -> Column:
    return _known(F.greatest(_c(a), _c(low)), _c(a), _c(low))


def clip(a, low=None, high=None) -> Column:
    """Clamped to low..high; a bound of None is not applied, a missing bound makes the cell missing."""
    out = _c(a)
    out = out if low is None else lclip(out, low)
    return out if high is None else hclip(out, high)


def is_in(a, values: Column) -> Column:
    """1 if an array column holds the value; NaN and missing never match."""
    a = _c(a)
    return F.coalesce((F.array_contains(values, a) & ~_nan(a)).cast("int"), F.lit(0))


def approx_artol(got, expected, atol: float = 1e-6, rtol: float = 0.0) -> Column:
    """1 if within atol, or within rtol of the expected size; missing matches missing and NaN matches NaN."""
    g, e = _c(got), _c(expected)
    near = (F.abs(g - e) <= atol) | (F.abs(g - e) <= F.abs(e) * rtol)
    both_nan = _nan(g) & _nan(e)
    ok = F.when(g.isNull() | e.isNull(), g.isNull() & e.isNull()).when(_nan(g) | _nan(e), both_nan).otherwise(near)
    return ok.cast("int")


def approx(got, expected, eps: float = 1e-6) -> Column:
    return approx_artol(got, expected, eps)


# missing values ------------------------------------------------------------------------------------


def isbad(a) -> Column:
    return _c(a).isNull().cast("int")


def isgood(a) -> Column:
    return _c(a).isNotNull().cast("int")


def isfinite(a) -> Column:
    a = _c(a).cast("double")
    return F.coalesce((~F.isnan(a) & (F.abs(a) < INF)).cast("int"), F.lit(0))


def setbadif(a, mask) -> Column:
    """Missing where the mask is true or itself missing."""
    return F.when(_c(mask).isNotNull() & (_c(mask).cast("double") == 0), _c(a))


def setvaltobad(a, value) -> Column:
    return F.nullif(_c(a), _c(value))


def setnantobad(a) -> Column:
    return F.when(~F.isnan(_c(a).cast("double")), _c(a))


def setinftobad(a) -> Column:
    """Only infinities become missing; NaN stays."""
    a = _c(a)
    return F.when(F.abs(a.cast("double")) != INF, a)


def setnonfinitetobad(a) -> Column:
    return F.when(isfinite(a) == 1, _c(a))


def setbadtonan(a) -> Column:
    return F.coalesce(_c(a).cast("double"), F.lit(float("nan")))


def setbadtoval(a, value) -> Column:
    return F.coalesce(_c(a), _c(value))


def badmask(a, b) -> Column:
    """b wherever a is missing or not finite."""
    return F.when(isfinite(a) == 1, _c(a)).otherwise(_c(b))


def copybad(a, mask) -> Column:
    return F.when(_c(mask).isNotNull(), _c(a))


# complex numbers: struct<re, im> ------------------------------------------------------------------


def czip(re, im) -> Column:
    return F.struct(_c(re).cast("double").alias("re"), _c(im).cast("double").alias("im"))


def r2c(re) -> Column:
    return czip(re, F.lit(0.0))


def i2c(im) -> Column:
    return czip(F.lit(0.0), im)


def re(z) -> Column:
    return _c(z)["re"]


def im(z) -> Column:
    return _c(z)["im"]


def conj(z) -> Column:
    return czip(re(z), -im(z))


def carg(z) -> Column:
    return F.atan2(im(z), re(z))


def cabs(z) -> Column:
    return F.hypot(re(z), im(z))


def cplus(a, b) -> Column:
    return czip(re(a) + re(b), im(a) + im(b))


def cmult(a, b) -> Column:
    return czip(re(a) * re(b) - im(a) * im(b), re(a) * im(b) + im(a) * re(b))


def csqrt(z) -> Column:
    """Principal square root."""
    r = cabs(z)
    half_im = F.sqrt((r - re(z)) / 2)
    return czip(F.sqrt((r + re(z)) / 2), F.when(im(z) < 0, -half_im).otherwise(half_im))


def csqrt_up(z) -> Column:
    """The square root in the upper half plane."""
    s = csqrt(z)
    flip = im(s) < 0
    return czip(F.when(flip, -re(s)).otherwise(re(s)), F.abs(im(s)))


def clog(z) -> Column:
    return czip(log(cabs(z)), carg(z))


def casin(z) -> Column:
    """Principal arc sine: -i log(i z + sqrt(1 - z^2))."""
    root = csqrt(cplus(r2c(F.lit(1.0)), cmult(r2c(F.lit(-1.0)), cmult(z, z))))
    w = clog(cplus(cmult(i2c(F.lit(1.0)), z), root))
    return czip(im(w), -re(w))


def cacos(z) -> Column:
    """Principal arc cosine: a right angle less the arc sine."""
    s = casin(z)
    return czip(F.lit(math.pi / 2) - re(s), -im(s))


def cacosh(z) -> Column:
    """Principal inverse of the hyperbolic cosine: log(z + sqrt(z + 1) sqrt(z - 1))."""
    return clog(cplus(z, cmult(csqrt(cplus(z, r2c(F.lit(1.0)))), csqrt(cplus(z, r2c(F.lit(-1.0)))))))


def catanh(z) -> Column:
    """Principal inverse of the hyperbolic tangent: half of log(1 + z) - log(1 - z)."""
    up, down = clog(cplus(r2c(F.lit(1.0)), z)), clog(cplus(r2c(F.lit(1.0)), cmult(r2c(F.lit(-1.0)), z)))
    return czip((re(up) - re(down)) / 2, (im(up) - im(down)) / 2)


# polynomials, colours, packed vectors ---------------------------------------------------------------


def polyval(coefficients: Column, x) -> Column:
    """Value at x of an array of coefficients, the highest order first."""
    return F.aggregate(coefficients, F.lit(0.0), lambda s, c: s * _c(x) + c)


def polyfromroots(roots: Column) -> Column:
    """Coefficients, the highest order first, of the monic polynomial with these real roots."""
    zero = F.array(F.lit(0.0))
    step = lambda p, r: F.zip_with(F.concat(p, zero), F.concat(zero, p), lambda a, b: a - b * r)
    return F.aggregate(roots, F.array(F.lit(1.0)), step)


def rgbtogr(r, g, b) -> Column:
    """Grey level by byte weights."""
    return (_c(r) * LUMA[0] + _c(g) * LUMA[1] + _c(b) * LUMA[2]) / 256


def bytescl(a, low, high, top: int = 255) -> Column:
    """low..high stretched to 0..top as whole numbers; data already within 0..top is only cast."""
    a, lo, hi = _c(a), _c(low), _c(high)
    inside = (lo >= 0) & (hi <= abs(top)) & F.lit(top >= 0)
    return F.when(inside, F.floor(a)).otherwise(F.floor(F.try_divide((a - lo) * abs(top), hi - lo) + 0.5)).cast("int")


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def inner(a: Column, b: Column) -> Column:
    """Dot product of packed vectors; one missing element makes it missing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def innerwt(a: Column, w: Column, b: Column) -> Column:
    return inner(F.zip_with(a, w, lambda x, y: x.cast("double") * y), b)


def inner2(a: Column, m: Column, b: Column) -> Column:
    """a . (m b) for a packed matrix m of rows."""
    return inner(a, F.transform(m, lambda row: inner(row, b)))


def inner2t(a: Column, b: Column, c: Column) -> Column:
    """The matrix of a (b c) for packed matrices: rows of a on rows of what columns of b and c make."""
    columns = lambda m: F.transform(F.sequence(F.lit(1), F.size(m[0])), lambda k: F.transform(m, lambda row: F.element_at(row, k.cast("int"))))
    times = lambda x, y: F.transform(x, lambda row: F.transform(columns(y), lambda column: inner(row, column)))
    return times(a, times(b, c))


def combcoords(x: Column, y: Column, z: Column) -> Column:
    """Three coordinates as one packed vector."""
    return F.array(*[c.cast("double") for c in (x, y, z)])


def inner2d(a: Column, b: Column) -> Column:
    """Sum of the products of all cells of two packed matrices."""
    return inner(F.flatten(a), F.flatten(b))


def norm(v: Column) -> Column:
    """Unit vector; a zero vector becomes NaN."""
    n = vector_norm(v)
    return F.transform(v, lambda x: divide(x, n))


def vcos(a: Column, b: Column) -> Column:
    """Cosine of packed vectors, elements missing on either side left out; NaN for a zero vector."""
    both = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    x, y = F.transform(both, lambda p: p["x"]), F.transform(both, lambda p: p["y"])
    return divide(inner(x, y), vector_norm(x) * vector_norm(y))


def crossp(a: Column, b: Column) -> Column:
    at = lambda v, i: F.element_at(v, i).cast("double")
    part = lambda i, j: at(a, i) * at(b, j) - at(a, j) * at(b, i)
    return F.array(part(2, 3), part(3, 1), part(1, 2))


def cmpvec(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by the first difference; missing if a missing element comes first."""
    signs = F.zip_with(a, b, spaceship)
    first = F.element_at(F.concat(F.filter(signs, lambda s: s.isNull() | (s != 0)), F.array(F.lit(0))), 1)
    return F.when(F.size(signs) > 0, first).otherwise(0)


def eqvec(a: Column, b: Column) -> Column:
    """1 if all elements are equal; missing if any is."""
    same = F.zip_with(a, b, eq)
    return F.when(~F.exists(same, lambda s: s.isNull()), F.forall(same, lambda s: s == 1).cast("int"))


# constants -----------------------------------------------------------------------------------------

PI, E = math.pi, math.e
DEG2RAD, RAD2DEG = math.pi / 180, 180 / math.pi
DIRECT = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "ceil": F.ceil, "floor": F.floor, "abs": F.abs, "isnan": F.isnan, "pow": F.pow}

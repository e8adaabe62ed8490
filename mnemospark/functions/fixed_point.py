"""Q16.16 fixed-point arithmetic and vector functions as column expressions.

Raw fixed values are 32-bit integers; sums are 64-bit, so distances are exact and order totally with the id.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the number format and its accepted range
SCALE = 65536
INT_MIN, INT_MAX = -2147483648, 2147483647
ROUND_MAX = 2147483520
LOWEST, HIGHEST = -32768.0, 32767.99


def in_range(vec: Column) -> Column:
    """True if every component is a number inside the accepted range."""
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= F.lit(LOWEST)) & (x <= F.lit(HIGHEST)))


def quantize(vec: Column) -> Column:
    """Truncation toward zero after a 32-bit float product; null when a component is out of range."""
    fixed = F.transform(vec, lambda x: (x.cast("float") * F.lit(float(SCALE)).cast("float")).cast("int"))
    return F.when(in_range(vec), fixed)


def quantize_round(vec: Column) -> Column:
    """Rounds half away from zero and clamps; positive infinity is the largest value, NaN the smallest."""

    def one(x: Column) -> Column:
        y = F.round(x.cast("double") * SCALE)
        return F.when(F.isnan(x), F.lit(INT_MIN)).otherwise(F.greatest(F.least(y, F.lit(float(ROUND_MAX))), F.lit(float(INT_MIN))).cast("int"))

    return F.transform(vec, one)


def quantize_cluster(vec: Column) -> Column:
    """Rounds, reads NaN as zero and clamps to 32 bits; the form that clustering uses."""
    return F.transform(vec, lambda x: F.greatest(F.least(F.round(F.nanvl(x.cast("double"), F.lit(0.0)) * SCALE), F.lit(float(INT_MAX))), F.lit(float(INT_MIN))).cast("int"))


def dequantize(fx: Column) -> Column:
    return F.transform(fx, lambda x: (x / SCALE).cast("float"))


def saturate(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(INT_MAX).cast("long")), F.lit(INT_MIN).cast("long")).cast("int")


def fx_add(a: Column, b: Column) -> Column:
    return saturate(a.cast("long") + b.cast("long"))


def fx_sub(a: Column, b: Column) -> Column:
    return saturate(a.cast("long") - b.cast("long"))


def fx_mul(a: Column, b: Column) -> Column:
    """The product's 16 low bits are floored away, then it saturates."""
    return saturate(F.shiftright(a.cast("long") * b.cast("long"), 16))


def _fold(a: Column, b: Column, step) -> Column:
    return F.aggregate(F.zip_with(a, b, step), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("long")))


def l2_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences in 64 bits over the shorter length (a missing partner adds nothing)."""
    return _fold(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long")))


def raw_dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x.cast("long") * y.cast("long"))


def fx_dot(a: Column, b: Column) -> Column:
    return saturate(F.shiftright(raw_dot(a, b), 16))


def l2_float(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two fixed vectors; null when either has no length."""
    norms = F.sqrt(raw_dot(a, a).cast("double")) * F.sqrt(raw_dot(b, b).cast("double"))
    return F.try_divide(raw_dot(a, b).cast("double"), F.nullif(norms, F.lit(0.0)))


def score(distance: Column) -> Column:
    """A fixed-point squared distance in real units."""
    return distance / F.lit(float(SCALE) * SCALE)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def binarize(vec: Column) -> Column:
    """Sign bits (1 where positive), 64 to a word, lowest first, as an array of longs."""
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vec) / 64).cast("int") - 1, F.lit(0)))

    def word(w: Column) -> Column:
        part = F.slice(vec, w * 64 + 1, 64)
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.transform(words, word)


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def scalar_quantize(vec: Column) -> Column:
    """Components clamped to [-1, 1] and mapped to 0..255."""
    return F.transform(vec, lambda x: ((F.greatest(F.least(x.cast("float"), F.lit(1.0).cast("float")), F.lit(-1.0).cast("float")) + F.lit(1.0).cast("float")) * F.lit(127.5).cast("float")).cast("int"))


def scalar_dequantize(codes: Column) -> Column:
    return F.transform(codes, lambda b: b / 127.5 - 1)

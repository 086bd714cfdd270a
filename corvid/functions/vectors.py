"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Both norms get 1e-12, so a zero vector gives 0."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    n = norm(a) + 1e-12
    return F.transform(a, lambda x: x.cast("double") / n)


def truncated(a: Column, dims: int) -> Column:
    """The first dimensions, made unit length again; unchanged if there are no more than ``dims``."""
    return F.when(F.size(a) > dims, unit(F.slice(a, 1, dims))).otherwise(F.transform(a, lambda x: x.cast("double")))


def int8(a: Column) -> Column:
    """Quantised by the largest magnitude, rounded half to even: the array and what it is scaled by."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127 + 1e-12
    q = F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") / scale))).cast("int"))
    return F.struct(q.alias("q"), scale.alias("scale"))


def nbit(a: Column, bits: int) -> Column:
    """Uniform scalar quantisation between the vector's least and largest value, restored to midpoints of its steps."""
    top = float((1 << bits) - 1)
    lo = F.array_min(F.transform(a, lambda x: x.cast("double")))
    step = (F.array_max(F.transform(a, lambda x: x.cast("double"))) - lo) / top + 1e-12
    return F.transform(a, lambda x: lo + F.rint((x.cast("double") - lo) / step) * step)


def sign_codes(a: Column, dims: int) -> Column:
    """One bit for each value that is 0 or more, big-endian in 64-bit words."""
    def word(k: int) -> Column:
        width = min(64, dims - 64 * k)
        bits = F.transform(F.slice(a, 64 * k + 1, width), lambda x: F.when(x >= 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))

    return F.array(*(word(k) for k in range(-(-dims // 64))))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

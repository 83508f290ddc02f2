"""Column functions on arrays of numbers; everything is computed in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def finite(v: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def l2_normalize(v: Column) -> Column:
    """The vector over its norm; a zero vector stays, and one whose norm isn't finite becomes zero."""
    n = norm(v)
    bad = F.coalesce(~finite(v) | F.isnan(n) | (n == float("inf")), F.lit(True))
    return F.when(bad, F.transform(v, lambda x: F.lit(0.0))).when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def truncate(v: Column, dims: int) -> Column:
    """The leading dimensions, normalized again."""
    return l2_normalize(F.slice(v, 1, dims))


def sign_words(v: Column) -> Column:
    """One bit a dimension (1 if positive), in 63-bit words, so that no word is negative: array<bigint>."""
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % 63).cast("int"))).otherwise(F.lit(0).cast("bigint")))
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 63).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(bits, w * 63 + 1, 63), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)

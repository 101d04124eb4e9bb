"""Vectors, bits and percentiles as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its length; null for a zero vector or one that is not finite."""
    return let(norm(a), lambda n: F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(a, lambda x: x / n)))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of unit vectors, kept inside [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column, bits: int = 63) -> Column:
    """A hash of the signs of a vector's first components, up to 64."""
    chosen = F.slice(vector, 1, bits)
    return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: a plain Column that f uses often is computed as often inside array functions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rounded(x: Column, places: int) -> Column:
    """x times 10**places to the nearest whole number, halves away from zero, over 10**places: the product is what counts, as
    in C's round(), while Spark's round() goes by the shortest decimal digits of x."""
    scale = float(10**places)
    whole = F.floor(F.abs(x) * scale)
    up = (F.abs(x) * scale - whole >= 0.5).cast("double")
    return F.signum(x) * (whole + up) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """null, never 0, where there is nothing to divide by."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))

"""Vector functions on arrays, computed in double inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("x"), F.array_repeat(norm(a), F.size(a)).alias("n")), lambda p: p["x"].cast("double") / p["n"])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sign_bits(a: Column) -> Column:
    """The signs of up to 64 elements as a 64-bit integer, the first sign highest: a bit is set if the element is positive.

    More elements are an error: project them to 64 first.
    """
    bits = F.aggregate(F.transform(a, lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return F.when(F.size(a) > 64, F.raise_error(F.lit("a 64-bit hash takes up to 64 signs")).cast("long")).otherwise(bits)


def known_bits(a: Column) -> Column:
    """The bits of sign_bits that come from elements which are not null."""
    return F.aggregate(F.transform(a, lambda x: F.when(x.isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))

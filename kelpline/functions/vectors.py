"""Vector expressions over arrays, JVM-side: similarity, normalisation and int8 quantisation."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or a norm is zero."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def normalise(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


#: Smallest difference of single precision at 1; a narrower range is scaled by 1.
EPSILON = 1.1920929e-07


def quantise(a: Column) -> Column:
    """STRUCT<values ARRAY<TINYINT>, min DOUBLE, scale DOUBLE>; an empty vector gives ([], 0, 0)."""
    low, high = F.array_min(a).cast("double"), F.array_max(a).cast("double")
    scale = F.when(high - low < EPSILON, F.lit(1.0)).otherwise((high - low) / 255)
    q = F.transform(a, lambda v: F.greatest(F.lit(-128), F.least(F.lit(127), F.round((v.cast("double") - low) / scale - 128))).cast("tinyint"))
    return F.when(F.size(a) == 0, F.struct(F.array().cast("array<tinyint>").alias("values"), F.lit(0.0).alias("min"), F.lit(0.0).alias("scale"))).otherwise(F.struct(q.alias("values"), low.alias("min"), scale.alias("scale")))


def dequantise(values: Column, low: Column, scale: Column) -> Column:
    return F.transform(values, lambda q: (q.cast("double") + 128) * scale.cast("double") + low.cast("double"))


def int_dot(a: Column, b: Column) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def given_or_quantised(vec: Column, q: Column, low: Column, scale: Column) -> Column:
    """The vector, or what its quantised form gives back where it is missing."""
    return F.when(F.coalesce(F.size(vec), F.lit(0)) > 0, F.transform(vec, lambda x: x.cast("double"))).otherwise(dequantise(q, low, scale))


def pack_quantised(values: list[int], low: float, scale: float) -> bytes:
    """Wire form: two little-endian floats and the bytes."""
    return struct.pack("<ff", low, scale) + bytes(v & 0xFF for v in values)


def unpack_quantised(data: bytes) -> tuple[list[int], float, float] | None:
    if len(data) < 8:
        return None
    low, scale = struct.unpack("<ff", data[:8])
    return [b - 256 if b > 127 else b for b in data[8:]], low, scale

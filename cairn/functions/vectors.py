"""Vector and numeric functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; zero when lengths differ."""
    s = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), s).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda t, x: t + x * x))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays. The norm is bound once for a vector, as the one element of an array: inside the inner function it would be made for each component."""
    scaled = lambda n: F.transform(v.cast("array<double>"), lambda x: F.when(n > 0, x / n).otherwise(x))
    return F.element_at(F.transform(F.array(norm(v)), scaled), 1)


def quantize(v: Column, scale: Column) -> Column:
    """round-half-up(v / scale * 127), within 127 either way."""
    one = lambda x, s: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.floor(x / s * 127 + 0.5).cast("double")))
    return F.zip_with(v.cast("array<double>"), scale, lambda x, s: one(x, s).cast("tinyint"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.zip_with(q, scale, lambda x, s: x.cast("double") * s / 127)


def score_quantized(q: Column, query: Column, scale: Column) -> Column:
    """Sum of row * query * scale^2 over 127^2, of a quantised row and a quantised query."""
    weights = F.zip_with(query, scale, lambda x, s: x.cast("double") * s * s)
    s = F.aggregate(F.zip_with(q, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda t, x: t + x)
    return s / (127.0 * 127.0)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def effective_confidence(confidence: Column, durability: Column, days: Column) -> Column:
    """Confidence halved every 14 to 364 days, by durability."""
    return confidence * F.pow(F.lit(0.5), days / (F.lit(14.0) + F.lit(350.0) * durability))


def recommended_bits(n: int) -> int:
    """Bits of a signature for n vectors; none for 64 or fewer."""
    import math

    return 0 if n <= 64 else min(20, max(6, math.ceil(math.log2(n / 8))))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set; zero if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))

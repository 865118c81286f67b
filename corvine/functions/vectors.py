"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector: Column) -> Column:
    """The unit vector; a vector shorter than 1e-12 is returned as it is."""
    v = doubles(vector)
    length = F.array_repeat(norm(v), F.size(v))
    return F.when(norm(v) < TINY, v).otherwise(F.zip_with(v, length, lambda x, n: x / n))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of those state vectors whose mask is not 0; zeros if there is none."""
    width = F.size(F.element_at(states, 1))
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.when(m != 0, doubles(s))), lambda s: s.isNotNull())
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(kept, zero, lambda acc, s: F.zip_with(acc, s, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))

"""Similarities from counts, sets and vectors. h: common, a and b: set sizes or popcounts, m: filter length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))


def dice(h: Column, a: Column, b: Column) -> Column:
    """2h / (a + b); 0 where both are empty or missing."""
    return _ratio(2 * h, a + b)


def jaccard(h: Column, a: Column, b: Column) -> Column:
    return _ratio(h, a + b - h)


def overlap(h: Column, a: Column, b: Column) -> Column:
    return _ratio(h, F.least(a, b))


def hamming_coefficient(h: Column, a: Column, b: Column, m: int) -> Column:
    """1 - min(a - h, b - h) / m: 1 for a subset, not the true Hamming similarity. Missing values give 0."""
    return F.coalesce(1.0 - F.least(a - h, b - h).cast("double") / m, F.lit(0.0))


def entropy_coefficient(a: Column, b: Column) -> Column:
    """1 - |ln a - ln b|, over popcounts; 0 where a filter is empty."""
    return F.coalesce(F.when((a > 0) & (b > 0), 1.0 - F.abs(F.ln(a.cast("double")) - F.ln(b.cast("double")))), F.lit(0.0))


def byte_entropy(blob_values: Column) -> Column:
    """Entropy of byte values as weights, for the byte-wise variant of the entropy coefficient."""
    total = F.aggregate(blob_values, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(blob_values, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))


def set_hamming(h: Column, a: Column, b: Column) -> Column:
    """1 - |symmetric difference| / |union|, which is Jaccard."""
    return jaccard(h, a, b)


def bit_hamming(x: Column, m: int) -> Column:
    """1 - #(x xor y) / m."""
    return 1.0 - x.cast("double") / m


def bit_agreement(x: Column, m: int) -> Column:
    """max(0, 1 - 2 #(x xor y) / m)."""
    return F.greatest(F.lit(0.0), 1.0 - 2.0 * x.cast("double") / m)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """0 where a vector is zero."""
    return _ratio(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def angular(cos: Column) -> Column:
    """1 - acos(min(cos, 1)) / pi."""
    return 1.0 - F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))) / F.pi()


def euclid(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v))


def sorted_edge_difference(x: Column, y: Column) -> Column:
    """Mean absolute difference of two lists of similarities, both falling, cut to the shorter; 0 where one is empty."""
    n = F.least(F.size(x), F.size(y))
    falling = [F.slice(F.sort_array(v, asc=False), F.lit(1), F.greatest(n, F.lit(1))) for v in (x, y)]
    total = F.aggregate(F.zip_with(*falling, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    return F.when(n > 0, total / n).otherwise(0.0)


#: Set similarities by name, over (h, a, b).
SET_SIMILARITIES = {"dice": dice, "jaccard": jaccard, "overlap": overlap, "hamming": set_hamming}

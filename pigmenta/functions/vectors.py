"""Vector expressions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, with a small number that keeps zero vectors from dividing by zero."""
    return 1 - dot(a, b) / (norm(a) * norm(b) + 1e-10)


def similarity_of(distance: Column) -> Column:
    """A distance as a similarity between 0 and 1; null stays null."""
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance)))


def rounded(c: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)

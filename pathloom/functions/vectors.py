"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column, eps: float = EPS) -> Column:
    # bound to a variable: read inside the inner function, the norm would be computed again for every element
    return F.transform(F.array(norm(v) + F.lit(eps)), lambda n: F.transform(v, lambda x: x / n))[0]


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def cosine_similarity(a: Column, b: Column, eps: float = EPS) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(eps)) * (norm(b) + F.lit(eps)))


def confidence(dist: Column) -> Column:
    return F.greatest(F.lit(0.0), F.round(F.lit(1.0) - dist, 4))

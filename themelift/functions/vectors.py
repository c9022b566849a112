"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2(v: Column) -> Column:
    """Unit-length float vector; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(
        F.transform(v, lambda x: x.cast("float"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, rounded so that equal inputs compare equal."""
    return F.round(dot(a, b), DIGITS)


def to_distance(similarity: Column) -> Column:
    return F.round(F.lit(1.0) - similarity, DIGITS)


def to_similarity(distance: Column) -> Column:
    return F.round(F.lit(1.0) - distance, DIGITS)

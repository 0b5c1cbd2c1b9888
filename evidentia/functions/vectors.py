"""Vector expressions in double precision; zero vectors have the similarity NaN, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null unless both have the same number of elements."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(size == 0, float("nan")).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0))))


def strict_cosine(a: Column, b: Column) -> Column:
    """The same, but a missing vector, another number of elements or a zero vector raises an error."""
    problem = (
        F.when(a.isNull() | b.isNull(), "a vector is missing").when(F.size(a) != F.size(b), "vectors of different dimensions").when((norm(a) == 0) | (norm(b) == 0), "a vector is zero")
    )
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("double")).otherwise(cosine(a, b))


def usable(a: Column, dimension: int) -> Column:
    """Of the given dimension, all elements present and finite."""
    fine = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(a) == dimension) & fine, F.lit(False))


def to_text(a: Column) -> Column:
    """``[1.0,2.0]``"""
    return F.to_json(a)


def from_text(a: Column) -> Column:
    return F.from_json(a, "array<float>")

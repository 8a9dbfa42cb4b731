"""Vector columns (``array<float>``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import registry as R


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, p: total + p))


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (norm(left) * norm(right) + F.lit(R.COSINE_EPSILON))


def unit(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(
        vector, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))
    )


def argmax(scores: Column) -> Column:
    """0-based position of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

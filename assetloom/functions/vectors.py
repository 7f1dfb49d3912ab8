"""Vector arithmetic on array columns, in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    """Sum of products as doubles; null if the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero, NaN where an element is."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its norm, zero vectors as they are."""
    length = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), length), F.lit(0.0)))


def mean_of(scores: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for s in scores:
        total = total + F.coalesce(s, F.lit(0.0))
    return total / len(scores)

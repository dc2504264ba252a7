"""Vector arithmetic on array columns, and the scores that retrieval ranks by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def valid(a: Column, width: int) -> Column:
    """Of the width, finite, and not all zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(a) == width) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))).cast("double")), F.lit(0.0))


def coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct elements that the text holds."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, text)).cast("double"), F.size(F.array_distinct(query)).cast("double")), F.lit(0.0))


def relevance(similarity: Column, *bonuses: Column) -> Column:
    """Similarity with bonuses, within -1 and 1."""
    total = similarity
    for b in bonuses:
        total = total + b
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))


def confidence(score: Column, high: float = 0.85, medium: float = 0.72) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")

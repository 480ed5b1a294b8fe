"""Arithmetic on arrays of numbers, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in double."""
    n = F.least(F.size(a), F.size(b))
    zipped = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize_vector(v: Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def clamp01(x: Column) -> Column:
    """Into 0 to 1; null, NaN and infinities: 0."""
    x = x.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    """Without overflow for either sign."""
    z = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + z)).otherwise(z / (1 + z))


def inverse_document_frequency(documents: Column, frequency: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)); 0 for a term of no document."""
    return F.when(F.coalesce(frequency, F.lit(0)) == 0, 0.0).otherwise(F.log(1 + (documents - frequency + 0.5) / (frequency + 0.5)))

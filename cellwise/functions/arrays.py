"""Column expressions on vectors (array<double>) and distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, floor: float = 1e-12) -> Column:
    """The vector over its length, which counts as `floor` at least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(floor)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null if one of the vectors is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def participation_ratio(a: Column) -> Column:
    """(sum w)^2 / sum w^2, the effective count of weights; null if all are zero."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return total * total / F.nullif(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x), F.lit(0.0))


def centred_log_ratio(a: Column, offset: float = 1e-3) -> Column:
    logs = F.transform(a, lambda x: F.log(x + offset))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.transform(logs, lambda x: x - mean)

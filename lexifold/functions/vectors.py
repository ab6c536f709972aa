"""Vector expressions on ``ARRAY<FLOAT>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, product: total + product,
    )


def unit_length(vector: Column) -> Column:
    """Scale to length one; a zero vector stays as it is."""
    norm = F.sqrt(_dot(vector, vector))
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda x: (x / norm).cast("float")))


def cosine_similarity(left: Column, right: Column) -> Column:
    """0 when the lengths differ, one vector has no length, or one holds a number that is not finite."""
    norms = _dot(left, left) * _dot(right, right)
    similarity = F.when((F.size(left) != F.size(right)) | (norms == 0), F.lit(0.0)).otherwise(
        _dot(left, right) / F.sqrt(norms)
    )
    return F.nanvl(similarity, F.lit(0.0))


def stable(score: Column, digits: int) -> Column:
    """Round before ranking: sums arrive in any order on a cluster, and the last bits must not decide a rank."""
    scale = float(10**digits)
    return F.rint(score * scale) / scale

"""Vectors, scores and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_half_up


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, the cosine of unit vectors; 0 for empty ones; an error when sizes differ."""
    d = lambda x: x.cast("double")
    value = F.aggregate(F.zip_with(a, b, lambda x, y: d(x) * d(y)), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors have different dimensions")).cast("double"))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def to_score(similarity: Column) -> Column:
    """-1..1 (clamped) to 0..100, halves up."""
    return round_half_up((F.greatest(F.least(similarity, F.lit(1.0)), F.lit(-1.0)) + 1) / 2 * 100)


def to_similarity(score: Column) -> Column:
    return F.greatest(F.least(score.cast("double"), F.lit(100.0)), F.lit(0.0)) / 100 * 2 - 1


def session_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "great").when(score >= 50, "good").otherwise("needs-work")


def note_band(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 70, "high").when(score >= 50, "medium").when(score >= 30, "low").otherwise("minimal")


def progress(done: Column, total: Column) -> Column:
    """Percent, 0 to 100; null when there is nothing to do."""
    return F.when(total != 0, F.least(F.greatest(F.try_divide(done.cast("double"), total.cast("double")) * 100, F.lit(0.0)), F.lit(100.0)))

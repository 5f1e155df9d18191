"""Dense-vector expressions over ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision (elements cast before multiplying)."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(F.aggregate(
        F.transform(a, lambda x: x.cast("double") * x.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, v: acc + v,
    ))


def cosine_from_parts(dot_col: Column, norm_a: Column, norm_b: Column) -> Column:
    """dot / (|a|·|b|); a zero vector scores 0 instead of raising under ANSI."""
    return F.coalesce(F.try_divide(dot_col, norm_a * norm_b), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    return cosine_from_parts(dot(a, b), norm(a), norm(b))


def rounded(c: Column, places: int = 6) -> Column:
    """Scores are compared and thresholded after rounding to ``places``."""
    return F.round(c, places)

"""Vector and score arithmetic (A17, Q14, U9) on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is null, empty or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def scaled(score: Column) -> Column:
    """A cosine on 0..1."""
    return 0.5 * score + 0.5


def min_max(score: Column, window) -> Column:
    """Scores of one list on 0..1; all equal are 1."""
    lo, hi = F.min(score).over(window), F.max(score).over(window)
    return F.when(hi == lo, 1.0).otherwise((score - lo) / (hi - lo))


def reciprocal(rank: Column, offset: int = 0) -> Column:
    """1 / (rank + offset) of a rank from 1."""
    return 1.0 / (rank + offset)

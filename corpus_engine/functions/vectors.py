"""Vector columns: Euclidean distance, similarity and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def similarity(distance: Column) -> Column:
    """1 - distance: 1 for equal vectors, without lower bound."""
    return 1 - distance


def is_blank_vector(v: Column) -> Column:
    """Missing, empty or all zero."""
    return v.isNull() | (F.size(v) == 0) | F.forall(v, lambda x: x == 0)

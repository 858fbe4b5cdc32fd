"""Rectangles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Area that two rectangles (left, top, width, height) share."""
    side = lambda p, q, i: F.greatest(F.least(p[i] + p[i + 2], q[i] + q[i + 2]) - F.greatest(p[i], q[i]), F.lit(0.0))
    return side(a, b, 0) * side(a, b, 1)

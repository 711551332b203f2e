"""Column functions for time: seconds to whole milliseconds, overlap, intersection over hull."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds, halves to even."""
    return F.rint(seconds * 1000).cast("bigint")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(a1, b1) - F.greatest(a0, b0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over the hull of both intervals; 0 for an empty hull."""
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, overlap(a0, a1, b0, b1) / hull).otherwise(F.lit(0.0))


def round_half_even(value: Column, digits: int) -> Column:
    return F.rint(value * float(10**digits)) / float(10**digits)

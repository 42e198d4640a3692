"""Masks as words of 64 pixels: area, overlap and votes without leaving Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.bit_count(w))


def overlap(a: Column, b: Column) -> Column:
    """Pixels of both masks, which must share their region."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0).cast("long"), lambda s, n: s + n)


def iou(a: Column, b: Column, area_a: Column, area_b: Column) -> Column:
    """Intersection over union by inclusion and exclusion; two empty masks are equal."""
    both = overlap(a, b)
    union = area_a + area_b - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def signs(values: Column) -> Column:
    """One word whose bit i tells whether value i is positive (64 values at most)."""
    return F.aggregate(
        F.transform(values, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b),
    )

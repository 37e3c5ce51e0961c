"""Expressions over arrays of numbers."""

from __future__ import annotations

from bisect import insort

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two vectors of one length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def longest_uniform(x: list, tolerance: float = 0.25) -> list:
    """The longest slice of three or more positions whose gaps are within a tolerance of their median, the first on ties.

    A start is left as soon as its gaps are too far apart for any median, or too few are left.
    """
    gaps_ = [b - a for a, b in zip(x, x[1:])]
    start, most = 0, 1
    for i in range(len(gaps_)):
        if len(gaps_) - i <= most:
            break
        held: list = []
        for j in range(i, len(gaps_)):
            insort(held, gaps_[j])
            low, high, n = held[0], held[-1], len(held)
            if low <= 0 or low * (1 + tolerance) < high * (1 - tolerance) * (1 - 1e-9):
                break
            m = (held[(n - 1) // 2] + held[n // 2]) / 2
            if n > most and m - low <= tolerance * m and high - m <= tolerance * m:
                start, most = i, n
    return x[start : start + most + 1] if most > 1 else []


def overlap(box: Column, other: Column) -> Column:
    """Share of a box (x, y, w, h) that another covers, 0 if it has no area."""
    side = lambda a, n: F.greatest(F.lit(0), F.least(box[a] + box[n], other[a] + other[n]) - F.greatest(box[a], other[a]))
    area = box["w"] * box["h"]
    return F.when(area == 0, 0.0).otherwise(side("x", "w") * side("y", "h") / area)

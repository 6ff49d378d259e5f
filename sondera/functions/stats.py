"""Intervals and small formulas on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): the interval of a share k of n; (0, 1) for n = 0."""
    n = n.cast("double")
    p, denom = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.struct(low.alias("low"), high.alias("high"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def growth(recent: Column, before: Column) -> Column:
    """recent / before; null where nothing was before or either was not measured."""
    return F.when(before > 0, recent / before)


def momentum(now: Column, before: Column) -> Column:
    """(now + 1) / (before + 1); null where both are 0 or either was not measured."""
    return F.when((now > 0) | (before > 0), (now + 1.0) / (before + 1.0))

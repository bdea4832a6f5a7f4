"""Exact order statistics of a column without sorting or collecting it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
SMALL = 100_000


def _finite(df: DataFrame, column: str) -> DataFrame:
    value = F.col(column).cast("double")
    return df.select(value.alias("v")).filter(value.isNotNull() & ~F.isnan(value))


def _range(values: DataFrame) -> tuple[float, float, int]:
    return tuple(values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first())


def nth_smallest(df: DataFrame, column: str, position: int) -> float:
    """Value at zero-based ``position`` of the ascending order."""
    values = _finite(df, column)
    return _narrow(values, position, *_range(values))


def _narrow(values: DataFrame, position: int, lo: float, hi: float, count: int) -> float:
    """Search for the position among ``count`` values from ``lo`` to ``hi``.

    Every round counts the candidates in equal-width bins (map-side partial
    sums, at most ``BINS`` result rows) and keeps the bin that holds the
    position. The smallest and largest candidate never share a bin, so each
    round shrinks the range; the loop ends when it is a single value or few
    enough rows remain to look at.
    """
    if not 0 <= position < count:
        raise ValueError(f"position {position} outside 0..{count - 1}")
    left = position
    while lo < hi and count > SMALL:
        width = (hi - lo) / BINS
        inside = values.filter(F.col("v").between(lo, hi))
        slot = F.least(F.floor((F.col("v") - lo) / width), F.lit(BINS - 1)) if width > 0 else (F.col("v") > lo)
        bins = (
            inside.groupBy(slot.cast("long").alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .orderBy("slot")
            .collect()
        )
        for row in bins:
            if left < row.n:
                lo, hi, count = row.lo, row.hi, row.n
                break
            left -= row.n
    if lo == hi:
        return lo
    rest = values.filter(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    for row in rest.orderBy("v").collect():
        if left < row.n:
            return row.v
        left -= row.n
    raise AssertionError("the input changed between two scans")


def quantile(df: DataFrame, column: str, share: float) -> float:
    """Linearly interpolated quantile over the finite values."""
    values = _finite(df, column)
    lo, hi, count = _range(values)
    place = share * (count - 1)
    below = math.floor(place)
    low = _narrow(values, below, lo, hi, count)
    if place == below:
        return low
    upto, above = values.agg(F.count_if(F.col("v") <= low), F.min(F.when(F.col("v") > low, F.col("v")))).first()
    high = low if upto > below + 1 else above
    return low + (high - low) * (place - below)


def flag_low(df: DataFrame, column: str, share: float, flag: str = "flagged") -> tuple[DataFrame, float]:
    """Rows at or below the quantile are flagged, ties included; null and NaN are not."""
    threshold = quantile(df, column, share)
    return df.withColumn(flag, F.coalesce((F.col(column) <= F.lit(threshold)) & ~F.isnan(column), F.lit(False))), threshold


def flag_high(df: DataFrame, column: str, share: float, flag: str = "flagged") -> tuple[DataFrame, float]:
    """The top ``share`` of the rows (at least one) is flagged, ties included; null and NaN are not."""
    values = _finite(df, column)
    lo, hi, count = _range(values)
    threshold = _narrow(values, count - max(1, int(count * share)), lo, hi, count)
    return df.withColumn(flag, F.coalesce((F.col(column) >= F.lit(threshold)) & ~F.isnan(column), F.lit(False))), threshold

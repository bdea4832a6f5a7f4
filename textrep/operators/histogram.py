"""Equal-width histograms and their smoothed curves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bins of a histogram, reach and width of the smoothing kernel.
BINS = 80
REACH = 5
RADIUS = 1.25


def histogram(df: DataFrame, value: str, bins: int = BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., bin, centre, width, n)`` over [min, max], the last bin closed.

    A value that rounding puts on the wrong side of an edge is moved to the bin
    whose edges hold it. Empty bins are kept.
    """
    by = list(by)
    data = df.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null")
    ranges = data.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # A single value is widened to a range of one, as a histogram needs a width.
    flat = F.col("lo") == F.col("hi")
    ranges = ranges.select(
        *by,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    if by:
        placed = data.join(ranges, by)
    else:
        lo, hi, step = ranges.first()
        placed = data.select("v", F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(step).alias("step"))

    guess = F.least(F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))), F.lit(bins - 1))
    placed = placed.withColumn("g", guess.cast("int"))
    low_edge = F.col("lo") + F.col("g") * F.col("step")
    high_edge = F.when(F.col("g") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("g") + 1) * F.col("step"))
    moved = (
        F.col("g")
        - F.when(F.col("v") < low_edge, 1).otherwise(0)
        + F.when((F.col("v") >= high_edge) & (F.col("g") < bins - 1), 1).otherwise(0)
    )
    counts = placed.groupBy(*by, moved.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).alias("centre"),
        F.col("step").alias("width"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def kernel(reach: int = REACH, radius: float = RADIUS) -> list[float]:
    """Gaussian weights of the offsets -reach..reach, summing to one."""
    raw = [math.exp(-0.5 * (o / radius) ** 2) for o in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def smoothed(hist: DataFrame, by: tuple[str, ...] = (), count: str = "n") -> DataFrame:
    """Histogram counts convolved with the kernel; outside the range counts are 0."""
    window = Window.partitionBy(*by).orderBy("bin")
    value = F.col(count).cast("double")
    terms = [
        F.lead(value, o, 0.0).over(window) * w if o >= 0 else F.lag(value, -o, 0.0).over(window) * w
        for o, w in zip(range(-REACH, REACH + 1), kernel())
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return hist.withColumn("smooth", total)

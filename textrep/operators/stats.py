"""Exploratory counts and distribution summaries of the raw reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The percentiles reported for text lengths and word counts.
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def rating_counts(df: DataFrame) -> DataFrame:
    """Rows per rating in numeric order, missing ratings left out."""
    return df.filter(F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("n")).orderBy("rating")


def verified_percent(df: DataFrame, column: str = "verified_purchase") -> DataFrame:
    """Share of verified purchases among the rows that state it."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        (F.avg(F.col(column).cast("double")) * 100).alias("verified_percent"),
    )


def describe(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles per measure.

    Rows are first counted per distinct value, which map tasks combine locally,
    so the exact percentile sees one weighted row per distinct length instead
    of every row.
    """
    long_form = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("measure"), c.cast("long").alias("v")) for n, c in measures.items()])
        ).alias("m")
    ).select("m.*")
    counted = long_form.groupBy("measure", "v").agg(F.count(F.lit(1)).alias("n"))
    shares = F.array(*[F.lit(p) for p in PERCENTILES])
    value = F.col("v").cast("double")
    total, sum_x, sum_xx = F.sum("n").cast("double"), F.sum(value * F.col("n")), F.sum(value * value * F.col("n"))
    summary = counted.groupBy("measure").agg(
        F.sum("n").alias("count"),
        (sum_x / total).alias("mean"),
        sum_x.alias("_s"),
        sum_xx.alias("_ss"),
        F.min("v").alias("min"),
        F.percentile("v", shares, F.col("n")).alias("_p"),
        F.max("v").alias("max"),
    )
    spread = F.when(
        F.col("count") > 1,
        F.sqrt(F.greatest(F.col("_ss") - F.col("_s") * F.col("mean"), F.lit(0.0)) / (F.col("count") - 1)),
    )
    return summary.select(
        "measure",
        "count",
        "mean",
        spread.alias("std"),
        "min",
        *[F.col("_p")[i].alias(f"p{int(round(p * 100))}") for i, p in enumerate(PERCENTILES)],
        "max",
    )

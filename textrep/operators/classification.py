"""Confusion matrix and the scores that follow from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """``(truth, pred, n)`` for every pair of known classes, zero cells kept.

    The class list is the sorted distinct truths and predictions; only the
    counted pairs come from the data, so the grid has classes squared rows.
    """
    counted = predictions.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = counted.select(F.explode(F.array("truth", "pred")).alias("c")).distinct()
    listed = classes.agg(F.sort_array(F.collect_set("c")).alias("classes"))
    grid = listed.select(F.explode("classes").alias("truth"), "classes").select(
        "truth", F.explode("classes").alias("pred")
    )
    return grid.join(counted, ["truth", "pred"], "left").select(
        "truth", "pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(table: DataFrame, classes: list) -> DataFrame:
    """The matrix with one row per truth and one column per predicted class."""
    wide = table.groupBy("truth").pivot("pred", classes).agg(F.sum("n"))
    return wide.select(
        F.concat(F.lit("true_"), F.col("truth").cast("string")).alias("truth"),
        *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in classes],
    )


def class_scores(table: DataFrame) -> DataFrame:
    """``(class, support, precision, recall, f1)``; an undefined value is 0."""
    cells = table.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
                F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
            )
        ).alias("m"),
        F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
    )
    sums = cells.groupBy(F.col("m.class").alias("class")).agg(
        F.sum("m.t").alias("support"), F.sum("m.p").alias("predicted"), (F.sum("hit") / 2).alias("hit")
    )

    def ratio(over, under):
        return F.when(under > 0, over / under).otherwise(0.0)

    return sums.select(
        "class",
        "support",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def overall_scores(table: DataFrame) -> DataFrame:
    """One row ``(accuracy, macro_f1, weighted_f1)``."""
    rows = class_scores(table)
    return rows.agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


"""Linear probe: how well a linear classifier reads a target from the vectors."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrep.operators.classification import confusion, overall_scores
from textrep.operators.sampling import SEED, train_test_split
from textrep.operators.vocab import label_codes

# Test share, penalty and iterations of the classifier.
TEST_SHARE = 0.2
L2 = 1e-4
ITERATIONS = 25


def probe_predictions(
    df: DataFrame, target: str, key: str = "row_id", vector: str = "embedding", test_share: float = TEST_SHARE,
    multinomial: bool = False, seed: int = SEED, iterations: int = ITERATIONS,
) -> DataFrame:
    """``(row_id, truth, pred)`` of the test rows; targets are cut to whole numbers.

    One classifier per class against the rest, or one softmax model, which
    needs fewer scans of the training rows.
    """
    valid = df.filter(F.col(target).isNotNull()).select(
        F.col(key).alias("row_id"), F.col(target).cast("int").alias("truth"),
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
    )
    coded = label_codes(valid, "truth").withColumn("label", F.col("code").cast("double"))
    train, test = train_test_split(coded, "truth", test_share, "row_id", seed)
    train = train.select("features", "label").persist()
    options = {"featuresCol": "features", "labelCol": "label", "predictionCol": "guess"}
    base = LogisticRegression(regParam=L2, standardization=False, maxIter=iterations, **options)
    if multinomial:
        fitted = base.setFamily("multinomial").fit(train)
    else:
        fitted = OneVsRest(classifier=base, parallelism=4, **options).fit(train)
    names = coded.select(F.col("label").alias("guess"), F.col("truth").alias("pred")).distinct()
    return fitted.transform(test).select("row_id", "truth", "guess").join(names, "guess").select("row_id", "truth", "pred")


def evaluate_probe(df: DataFrame, target: str, **options) -> tuple[DataFrame, DataFrame]:
    """Confusion table and one row of accuracy, macro F1 and weighted F1."""
    table = confusion(probe_predictions(df, target, **options)).persist()
    return table, overall_scores(table)

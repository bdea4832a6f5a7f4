"""Linear projection of vectors and the two-dimensional comparison table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrep.operators.sampling import SEED, stratified_sample, uniform_sample

# Reduced width, sample of the comparison and margin of its axes.
REDUCED = 64
COMPARISON_SAMPLE = 50_000
MARGIN = 0.06


def reduce_dimensions(
    df: DataFrame, components: int = REDUCED, sample_size: int | None = None, keep: Sequence[str] = ("row_id",),
    key: str = "row_id", vector: str = "embedding", seed: int = SEED,
) -> DataFrame:
    """Principal components fitted on a sample and applied to every row.

    The number of components is at most the rows less two, and at least two.
    """
    rows = df.select(*keep, array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    basis = df
    if sample_size is not None:
        basis = uniform_sample(df.select(key, vector), sample_size, key, seed)
    width = max(2, min(components, df.count() - 2))
    fit_on = basis.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    model = PCA(k=width, inputCol="_features", outputCol="_reduced").fit(fit_on)
    return model.transform(rows).select(*keep, vector_to_array("_reduced").alias("embedding"))


def comparison(
    df: DataFrame, label: str, clusters: DataFrame | None = None, sample_size: int = COMPARISON_SAMPLE,
    key: str = "row_id", vector: str = "embedding", seed: int = SEED,
) -> DataFrame:
    """``(row_id, label, x, y[, cluster])`` of a stratified sample."""
    named = df.select(key, F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label"), vector)
    sample = stratified_sample(named, "label", sample_size, key, seed)
    flat = reduce_dimensions(sample, 2, None, (key, "label"), key, vector, seed)
    points = flat.select(key, "label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    if clusters is None:
        return points
    return points.join(clusters.select(key, "cluster"), key, "left")


def axis_limits(points: DataFrame) -> DataFrame:
    """Range of both axes with a margin."""
    ranges = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    pad = {c: (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * MARGIN for c in ("x", "y")}
    return ranges.select(
        *[e for c in ("x", "y") for e in (
            (F.col(f"lo_{c}") - pad[c]).alias(f"{c}_low"), (F.col(f"hi_{c}") + pad[c]).alias(f"{c}_high"))]
    )

"""Isolation forest scores and rating inconsistencies."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.functions.vectors import matrix
from textrep.operators.sampling import SEED
from textrep.operators.select import flag_high, flag_low, quantile
from textrep.session import cut_lineage

# Forest size, rows per tree, flagged share, ridge weights.
TREES = 100
ROWS_PER_TREE = 10_000
CONTAMINATION = 0.01
L2 = 1e-4
RIDGE_ALPHA = 1.0

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def average_path(rows: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``rows`` values."""
    n = np.asarray(rows, np.float64)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, deep))


def _grow(seed: int, rows_per_tree: int, vector: str):
    """Group function: one isolation tree, grown level by level on its own rows."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pick", "row_id"]).head(rows_per_tree)
        tree = int(pdf["tree"].iloc[0])
        data = np.stack(pdf[vector].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(2, len(data))))
        nodes: list[tuple] = []
        rows, owner = np.arange(len(data)), np.zeros(len(data), np.int64)
        ids, next_id = np.array([0]), 1
        for level in range(limit + 1):
            order = np.argsort(owner, kind="stable")
            rows, owner = rows[order], owner[order]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(rows)])
            low = np.minimum.reduceat(data[rows], starts, axis=0)
            high = np.maximum.reduceat(data[rows], starts, axis=0)
            varied = high > low
            split = (sizes > 1) & varied.any(axis=1) & (level < limit)
            feature = np.where(varied, rng.random(varied.shape), -1.0).argmax(axis=1)
            here = np.arange(len(starts))
            lo, hi = low[here, feature], high[here, feature]
            cut = lo + rng.random(len(starts)) * (hi - lo)
            cut = np.where(cut >= hi, lo, cut)
            left = np.full(len(starts), -1)
            left[split] = next_id + 2 * np.arange(split.sum())
            depth = level + average_path(sizes)
            for i in here:
                if split[i]:
                    nodes.append((tree, ids[i], feature[i], cut[i], left[i], left[i] + 1, 0.0))
                else:
                    nodes.append((tree, ids[i], -1, 0.0, -1, -1, depth[i]))
            place = np.repeat(here, sizes)
            alive = split[place]
            rows, place = rows[alive], place[alive]
            if not len(rows):
                break
            ids = np.sort(np.r_[left[split], left[split] + 1])
            goes_right = data[rows, feature[place]] > cut[place]
            owner = left[place] + goes_right
            next_id = int(ids[-1]) + 1
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])

    return grow


def grow_forest(
    table: DataFrame, rows: int, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE,
    key: str = "row_id", vector: str = "embedding", seed: int = SEED,
) -> DataFrame:
    """Node table of the forest; every tree sees ``rows_per_tree`` rows of the table.

    A row joins a tree when its hash falls below a share that yields a little
    more than needed. The list of its trees comes from the hashes alone, so only
    rows of some tree are copied; the tree then takes its exact number in hash order. A group is bounded by that share.
    """
    wanted = min(rows_per_tree, rows)
    margin = wanted + 8 * math.sqrt(wanted) + 8
    cut = min(1.0, margin / rows)
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda tree: F.struct(
            tree.alias("tree"), F.shiftrightunsigned(F.xxhash64(F.col("row_id"), tree, F.lit(seed)), 1).alias("pick")
        ),
    )
    joined = picks if cut >= 1.0 else F.filter(picks, lambda p: p["pick"] <= int(cut * 2**63))
    rows = table.select(F.col(key).alias("row_id"), F.col(vector).cast("array<double>").alias(vector))
    chosen = rows.select("row_id", vector, F.explode(joined).alias("_p")).select("row_id", vector, "_p.*")
    return chosen.groupBy("tree").applyInPandas(_grow(seed, wanted, vector), NODE_SCHEMA)


def _forest_arrays(nodes: DataFrame) -> list[tuple[np.ndarray, ...]]:
    """The forest on the driver: at most trees x 2 x rows per tree nodes."""
    table = nodes.orderBy("tree", "node").toArrow().to_pandas()
    return [
        tuple(t[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth"))
        for _, t in table.groupby("tree")
    ]


def _normality(shared, keep: int, names: list[str]):
    """Task function: minus the isolation score of every row, lower is stranger."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, usual = shared.value
        for batch in batches:
            rows = matrix(batch.column(keep))
            depth = np.zeros(len(rows))
            each = np.arange(len(rows))
            for feature, cut, left, right, leaf_depth in forest:
                at = np.zeros(len(rows), np.int64)
                moving = each
                while len(moving):
                    moving = moving[feature[at[moving]] >= 0]
                    node = at[moving]
                    below = rows[moving, feature[node]] <= cut[node]
                    at[moving] = np.where(below, left[node], right[node])
                depth += leaf_depth[at]
            score = -np.power(2.0, -depth / (len(forest) * usual))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(keep)], pa.array(score)], names=[*names, "normality"]
            )

    return scan


def forest_scores(df: DataFrame, shared, keep: Sequence[str] = ("row_id",), vector: str = "embedding") -> DataFrame:
    """``keep`` columns plus ``normality`` for every row, given a broadcast forest."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("normality", T.DoubleType())])
    rows = df.select(*keep, F.col(vector).cast("array<double>"))
    return rows.mapInArrow(_normality(shared, len(keep), list(keep)), schema)


def isolation_scores(
    df: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES,
    rows_per_tree: int = ROWS_PER_TREE, keep: Sequence[str] = ("row_id",), key: str = "row_id",
    vector: str = "embedding", seed: int = SEED,
) -> DataFrame:
    """``keep`` columns plus ``iso_score``: normality above the contamination
    quantile of all rows, so that about that share lies below zero."""
    total = df.count()
    nodes = grow_forest(df, total, trees, rows_per_tree, key, vector, seed)
    usual = float(average_path(min(rows_per_tree, total)))
    shared = df.sparkSession.sparkContext.broadcast((_forest_arrays(nodes), usual))
    scored = cut_lineage(forest_scores(df, shared, keep, vector), "normality")
    offset = quantile(scored, "normality", contamination)
    return scored.select(*keep, (F.col("normality") - offset).alias("iso_score"))


def outliers(df: DataFrame, contamination: float = CONTAMINATION, **options) -> DataFrame:
    """Older form: a row is an outlier when its score is below zero."""
    scored = isolation_scores(df, contamination, rows_per_tree=256, **options)
    return scored.withColumn("iso_anomaly", F.col("iso_score") < 0)


def rating_predictions(
    df: DataFrame, keep: Sequence[str] = ("row_id",), rating: str = "rating", vector: str = "embedding",
    l2: float = L2,
) -> DataFrame:
    """``keep`` columns, ``predicted_rating`` and ``rating_residual`` of a linear model.

    The model minimises the mean of half the squared error plus ``l2`` / 2 times
    the squared weights. Spark scales the label to unit deviation first, so its
    parameter is ``l2`` times that deviation.
    """
    rows = df.select(
        *keep, F.col(rating).cast("double").alias("_y"),
        array_to_vector(F.col(vector).cast("array<double>")).alias("_features"),
    )
    deviation = rows.agg(F.stddev_pop("_y")).first()[0] or 1.0
    model = LinearRegression(
        featuresCol="_features", labelCol="_y", predictionCol="predicted_rating",
        regParam=l2 * deviation, elasticNetParam=0.0, standardization=False, solver="normal",
    ).fit(rows.filter("_y is not null").select("_features", "_y"))
    return model.transform(rows).select(
        *keep, "predicted_rating", F.abs(F.col("_y") - F.col("predicted_rating")).alias("rating_residual")
    )


def rating_inconsistencies(
    df: DataFrame, share: float = CONTAMINATION, ridge: float | None = None, keep: Sequence[str] = ("row_id",),
    rating: str = "rating", vector: str = "embedding",
) -> tuple[DataFrame, float]:
    """Rows with flag ``inconsistent`` on the largest residuals, and the threshold.

    With ``ridge`` the penalty is that of a ridge regression on the summed
    squared error, which divides by the row count in the mean form used here.
    """
    l2 = L2 if ridge is None else ridge / df.filter(F.col(rating).isNotNull()).count()
    scored = rating_predictions(df, keep, rating, vector, l2).persist()
    return flag_high(scored, "rating_residual", share, "inconsistent")


def anomaly_table(
    df: DataFrame, contamination: float = CONTAMINATION, trees: int = TREES,
    rows_per_tree: int = ROWS_PER_TREE, key: str = "row_id", vector: str = "embedding", seed: int = SEED,
) -> tuple[DataFrame, dict[str, float]]:
    """Row id, both scores and both flags for every row, and the two thresholds.

    The vector table carries its rating, so both models scan the same rows and
    their results meet in one join on the row id.
    """
    scores = isolation_scores(
        df, contamination, trees, rows_per_tree, (key,), key, vector, seed
    ).persist()
    flagged, low = flag_low(scores, "iso_score", contamination, "iso_anomaly")
    residuals, high = rating_inconsistencies(df, contamination, None, (key,), "rating", vector)
    return flagged.join(residuals, key), {"iso_score_threshold": low, "rating_residual_threshold": high}

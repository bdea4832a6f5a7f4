"""K-means over a vector table, full or by mini batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.functions.vectors import list_array, matrix
from textrep.operators.clustermetrics import agreement, contingency, silhouette
from textrep.operators.sampling import SEED, uniform_sample
from textrep.session import work_path

# Rows of one mini batch, at least, and passes over the table.
BATCH_ROWS = 16_384
PASSES = 1
# Batches of a pass, at most, and passes that draw the first centres.
ROUNDS = 16
SEED_STEPS = 5


def distinct_labels(df: DataFrame, label: str) -> int:
    """Number of label values, a missing label counting as one."""
    return df.select(label).distinct().count()


def kmeans(
    df: DataFrame, k: int, keep: Sequence[str] = ("row_id",), vector: str = "embedding",
    seed: int = SEED, iterations: int = 20,
) -> DataFrame:
    """``keep`` columns plus ``cluster``."""
    rows = df.select(*keep, array_to_vector(F.col(vector).cast("array<double>")).alias("_features"))
    trainer = KMeans(k=k, seed=seed, maxIter=iterations, featuresCol="_features", predictionCol="cluster")
    return trainer.fit(rows.select("_features").persist()).transform(rows).select(*keep, "cluster")


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row (the first of equals) and the squared distance to it."""
    square = (centres * centres).sum(axis=1) - 2 * rows @ centres.T
    found = square.argmin(axis=1)
    return found, np.maximum(square[np.arange(len(rows)), found] + (rows * rows).sum(axis=1), 0.0)


def _placed(shared, kept: Sequence[str]):
    """Task function: ``kept`` columns, nearest centre and squared distance of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, far = nearest(matrix(batch.column("_v")).reshape(batch.num_rows, -1), shared.value) if batch.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.int32()), pa.array(far, pa.float64())], names=[*kept, "cluster", "far"])

    return run


def _place(rows: DataFrame, centres: np.ndarray, kept: Sequence[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("cluster", T.IntegerType()), T.StructField("far", T.DoubleType())])
    return rows.select(*dict.fromkeys([*kept, "_v"])).mapInArrow(_placed(shared, kept), schema)


def _sums(rows: DataFrame, centres: np.ndarray) -> list:
    """``(cluster, n, sums)`` of the rows nearest to each centre; every task sends one state for each cluster."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(shared.value), np.int64), np.zeros(shared.value.shape)
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch.column("_v"))
                found, _ = nearest(values, shared.value)
                count += np.bincount(found, minlength=len(count))
                for cluster in np.unique(found):
                    total[cluster] += values[found == cluster].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), list_array(total[some], pa.float64())], names=["cluster", "n", "sums"])

    states = rows.select("_v").mapInArrow(run, "cluster int, n long, sums array<double>")
    merged = states.groupBy("cluster").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    found = merged.select("cluster", "n", vector_to_array("sums").alias("sums")).collect()
    shared.unpersist()
    return found


def draw(key: str, seed: int, step: int) -> Column:
    """A number from 0 to 1 that belongs to a row and a step."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(step)), F.lit(1 << 30)) / float(1 << 30)


def choose(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` of some weighted points, each drawn by its weight times the squared distance to those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (far * weights).any():
        chosen.append(int(rng.choice(len(points), p=far * weights / (far * weights).sum())))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def spread_centres(rows: DataFrame, k: int, key: str, seed: int, steps: int = SEED_STEPS) -> np.ndarray:
    """``k`` first centres that lie far apart, after ``steps`` passes over ``(key, _v)`` rows.

    Each pass draws about ``2 * k`` rows by their squared distance to those drawn before; the
    driver gets these and the number of rows nearest to each, and picks ``k``.
    """
    first = uniform_sample(rows, 1, key, seed).collect()
    if not first:
        return np.zeros((0, 0))
    points = np.array([r["_v"] for r in first], np.float64)
    for step in range(steps):
        placed = _place(rows, points, [key, "_v"])
        cost = placed.agg(F.sum("far")).first()[0]
        if not cost:
            break
        drawn = placed.filter(draw(key, seed, step) < 2 * k * F.col("far") / cost).select(key, "_v").orderBy(key).collect()
        points = np.unique(np.concatenate([points, np.array([r["_v"] for r in drawn], np.float64).reshape(len(drawn), points.shape[1])]), axis=0)
    weights = np.zeros(len(points))
    for r in _sums(rows, points):
        weights[r["cluster"]] = r["n"]
    return choose(points, weights, k, seed)


def mini_batch_kmeans(
    df: DataFrame, k: int, keep: Sequence[str] = ("row_id",), key: str = "row_id", vector: str = "embedding",
    batch_rows: int = BATCH_ROWS, passes: int = PASSES, seed: int = SEED, rounds: int = ROUNDS,
) -> DataFrame:
    """``keep`` columns plus ``cluster`` after mini-batch updates.

    The table is written once in at most ``rounds`` hash batches of ``batch_rows`` or more,
    one folder each, so a pass has as many jobs for any number of rows and a
    round reads its own batch only. Every task sends a (count, sum) for each cluster it met; a
    batch moves the centres (k vectors) towards its cluster means, weighted by the rows seen so far. The
    first centres lie far apart (``spread_centres``); finally every row gets its nearest
    centre. Copies of fewer than ``k`` rows make fewer clusters.
    """
    rows = df.withColumn("_v", F.col(vector).cast("array<double>"))
    batches = max(1, min(rounds, math.ceil(rows.count() / batch_rows)))
    path = work_path(df.sparkSession, "batches")
    number_of = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(batches)).cast("int")
    # A batch is one of few folders, so its rows are spread over many tasks.
    listed = rows.select(key, "_v", number_of.alias("_batch"))
    listed.write.partitionBy("_batch").parquet(path)
    stored = df.sparkSession.read.schema(T.StructType([listed.schema[key], *listed.schema.fields[1:]])).parquet(path)
    centres = spread_centres(stored.select(key, "_v"), k, key, seed)
    weight = np.zeros(len(centres))
    for _ in range(passes if len(centres) else 0):
        for number in range(batches):
            means = _sums(stored.filter(F.col("_batch") == number), centres)
            centres = centres.copy()
            for row in means:
                weight[row["cluster"]] += row["n"]
                centres[row["cluster"]] += (np.array(row["sums"]) / row["n"] - centres[row["cluster"]]) * (row["n"] / weight[row["cluster"]])
    return _place(rows, centres, list(keep)).select(*keep, "cluster")


def assign(df: DataFrame, centres: np.ndarray, keep: Sequence[str] = ("row_id",), vector: str = "embedding") -> DataFrame:
    """``keep`` columns, the nearest of the given centres (the first of equals) and the squared distance ``far``."""
    return _place(df.withColumn("_v", F.col(vector).cast("array<double>")), centres, list(keep))


def evaluate_clustering(
    df: DataFrame, label: str, key: str = "row_id", vector: str = "embedding", mini_batch: bool = False,
    sample_size: int = 20_000, seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Assignments with ``k`` = number of labels, and one row of NMI, ARI and silhouette."""
    k = distinct_labels(df, label)
    run = mini_batch_kmeans if mini_batch else kmeans
    assigned = run(df, k, keep=(key, label, vector), vector=vector, seed=seed).persist()
    table = contingency(assigned, label, "cluster")
    shape = silhouette(assigned, "cluster", key, vector, sample_size, seed)
    parts = agreement(table).unionByName(shape, allowMissingColumns=True)
    scores = parts.agg(*[F.max(c).alias(c) for c in ("nmi", "ari", "silhouette", "sample_size")])
    return assigned.select(key, label, "cluster"), scores.withColumn("n_clusters", F.lit(k))

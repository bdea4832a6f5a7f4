"""Cluster agreement (NMI, ARI) and the silhouette of a sample or of all rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrep.functions.vectors import matrix
from textrep.operators.sampling import SEED, uniform_sample

SILHOUETTE_SAMPLE = 20_000
BLOCK_BYTES = 64 << 20


def contingency(df: DataFrame, label: str = "label", cluster: str = "cluster") -> DataFrame:
    """Rows of every (label, cluster) pair; everything below works on this small table."""
    return df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def _with_margins(table: DataFrame) -> DataFrame:
    return table.select(
        F.col("n").cast("double").alias("n"),
        F.sum("n").over(Window.partitionBy("label")).cast("double").alias("a"),
        F.sum("n").over(Window.partitionBy("cluster")).cast("double").alias("b"),
    )


def agreement(table: DataFrame) -> DataFrame:
    """One row ``(nmi, ari)`` from a contingency table.

    All entropies follow from three sums of n*ln(.) and all pair counts from
    three sums of squares, so one aggregate over the cells is enough.
    """
    sums = _with_margins(table).agg(
        F.sum("n").alias("N"),
        F.sum(F.expr("n * ln(n)")).alias("cell"),
        F.sum(F.expr("n * ln(a)")).alias("row"),
        F.sum(F.expr("n * ln(b)")).alias("col"),
        F.sum(F.expr("n * n")).alias("sq"),
        F.sum(F.expr("n * a")).alias("sq_a"),
        F.sum(F.expr("n * b")).alias("sq_b"),
        F.max("a").alias("max_a"),
        F.max("b").alias("max_b"),
    )
    mutual = F.expr("greatest((cell - row - col) / N + ln(N), 0.0D)")
    mean_entropy = F.expr("((ln(N) - row / N) + (ln(N) - col / N)) / 2")
    one_class = F.expr("max_a = N and max_b = N")
    together, only_b, only_a = F.expr("sq - N"), F.expr("sq_b - sq"), F.expr("sq_a - sq")
    apart = F.expr("N * N - sq_a - sq_b + sq")
    spread = (together + only_a) * (only_a + apart) + (together + only_b) * (only_b + apart)
    return sums.select(
        F.when(one_class, 1.0).when(mean_entropy > 1e-15, mutual / mean_entropy).otherwise(0.0).alias("nmi"),
        F.when((only_a == 0) & (only_b == 0), 1.0)
        .otherwise(2.0 * (together * apart - only_a * only_b) / spread)
        .alias("ari"),
    )


def nmi(table: DataFrame) -> DataFrame:
    return agreement(table).select("nmi")


def ari(table: DataFrame) -> DataFrame:
    return agreement(table).select("ari")


def _distance_sums(shared):
    """Task function: for every row the sum of distances to each cluster of a block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, member = shared.value
        square = (points * points).sum(axis=1)
        for batch in batches:
            ids, own, rows = batch.column(0), batch.column(1), matrix(batch.column(2))
            sums = np.zeros((len(rows), member.shape[1]))
            for start in range(0, len(points), 2048):
                part = slice(start, start + 2048)
                squared = (rows * rows).sum(axis=1)[:, None] + square[part] - 2 * rows @ points[part].T
                # A point and its copies are at distance zero, whatever the rounding.
                squared[squared < 1e-12 * (1 + square[part])] = 0.0
                sums += np.sqrt(squared) @ member[part]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(ids.to_numpy(), sums.shape[1])),
                    pa.array(np.repeat(own.to_numpy(), sums.shape[1])),
                    pa.array(np.tile(np.arange(sums.shape[1]), len(rows)), pa.int32()),
                    pa.array(sums.reshape(-1)),
                ],
                names=["row_id", "own", "other", "total"],
            )

    return scan


def silhouette_of_sample(
    sample: DataFrame, cluster: str = "cluster", key: str = "row_id", vector: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row ``(silhouette, sample_size)``: exact Euclidean silhouette of the rows.

    The sample is compared with itself block by block; a block has a bounded
    size and leaves only one sum per row and cluster. Null when there is one
    cluster only or every row is its own cluster.
    """
    context = sample.sparkSession.sparkContext
    points = sample.select(
        F.col(key).cast("long").alias("row_id"),
        F.col(cluster).cast("int").alias("cluster"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.max(F.size("vector")).alias("dim"))
    known = sizes.orderBy("cluster").collect()
    total = sum(row["size"] for row in known)
    if not 1 < len(known) < total:
        return sizes.agg(F.lit(None).cast("double").alias("silhouette"), F.lit(total).cast("long").alias("sample_size"))
    code = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(known) for x in (r.cluster, i)]), F.col("cluster"))
    coded = points.select("row_id", code.alias("own"), "vector")
    spread = coded.repartition(max(1, min(context.defaultParallelism, math.ceil(total / 256))))
    blocks = max(1, math.ceil(total * (known[0].dim + len(known)) * 8 / block_bytes))
    sums = None
    for block in range(blocks):
        part = coded.filter(F.pmod(F.xxhash64("row_id"), F.lit(blocks)) == block) if blocks > 1 else coded
        table = part.orderBy("row_id").toArrow()
        if not table.num_rows:
            continue
        member = np.eye(len(known))[table.column(1).to_numpy()]
        shared = context.broadcast((matrix(table.column(2)), member))
        found = spread.mapInArrow(_distance_sums(shared), "row_id long, own int, other int, total double")
        sums = found if sums is None else sums.unionByName(found)
    if blocks > 1:
        sums = sums.groupBy("row_id", "own", "other").agg(F.sum("total").alias("total"))
    size_of = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(known) for x in (i, r["size"])]), F.col("other"))
    inside = F.col("own") == F.col("other")
    per_row = sums.withColumn("n", size_of).groupBy("row_id").agg(
        F.max(F.when(inside, F.try_divide("total", F.col("n") - 1))).alias("a"),
        F.min(F.when(~inside, F.col("total") / F.col("n"))).alias("b"),
        F.max(F.when(inside, F.col("n"))).alias("n"),
    )
    top = F.greatest("a", "b")
    width = F.when((F.col("n") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return per_row.agg(F.avg(width).alias("silhouette"), F.count(F.lit(1)).alias("sample_size"))


def silhouette(
    df: DataFrame, cluster: str = "cluster", key: str = "row_id", vector: str = "embedding",
    sample_size: int = SILHOUETTE_SAMPLE, seed: int = SEED,
) -> DataFrame:
    """Silhouette of a uniform sample of the table."""
    sample = uniform_sample(df.select(key, cluster, vector), sample_size, key, seed)
    return silhouette_of_sample(sample, cluster, key, vector)


def _squared_widths(shared):
    """Task function: sum of the silhouettes of its rows, and their number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, size, sums, squares, mean = shared.value
        found, rows = 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("vector")) - mean
            own = np.searchsorted(known, batch.column("cluster").to_numpy())
            apart = np.maximum((points * points).sum(axis=1)[:, None] * size + squares - 2 * points @ sums.T, 0.0)
            here = np.arange(len(points))
            a = apart[here, own] / np.maximum(size[own] - 1, 1)
            apart /= size
            apart[here, own] = np.inf
            b = apart.min(axis=1)
            top = np.maximum(a, b)
            some = (size[own] > 1) & (top > 0)
            found += float(((b - a)[some] / top[some]).sum())
            rows += len(points)
        yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([rows])], names=["found", "rows"])

    return scan


def silhouette_of_all(df: DataFrame, cluster: str = "cluster", vector: str = "embedding") -> DataFrame:
    """One row ``(silhouette, sample_size)``: silhouette of all rows by squared Euclidean distances.

    The mean squared distance of a row to a cluster follows from the cluster's count,
    sum and squared norms, so two scans do and no row meets another. Vectors are
    taken from one of them, so that far-off ones lose no digits. Rows without a
    cluster are left out. Null when there is one cluster only or every row is its own cluster.
    """
    points = df.select(F.col(cluster).cast("long").alias("cluster"), F.col(vector).cast("array<double>").alias("vector")).filter("cluster is not null")
    one = points.first()
    if one:
        origin = F.array(*map(F.lit, one["vector"]))
        points = points.withColumn("vector", F.zip_with("vector", origin, lambda x, o: x - o))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    stats = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), Summarizer.sum(array_to_vector("vector")).alias("sums"), F.sum(square).alias("squares"))
    known = sorted(stats.withColumn("sums", vector_to_array("sums")).collect())
    total = sum(r["size"] for r in known)
    if not 1 < len(known) < total:
        return stats.agg(F.lit(None).cast("double").alias("silhouette"), F.lit(total).cast("long").alias("sample_size"))
    size, sums, squares = (np.array([r[c] for r in known], np.float64) for c in ("size", "sums", "squares"))
    mean = sums.sum(axis=0) / total
    squares = squares - 2 * sums @ mean + size * (mean @ mean)
    shared = df.sparkSession.sparkContext.broadcast((np.array([r["cluster"] for r in known]), size, sums - size[:, None] * mean, squares, mean))
    parts = points.mapInArrow(_squared_widths(shared), "found double, rows long")
    return parts.agg((F.sum("found") / F.sum("rows")).alias("silhouette"), F.sum("rows").alias("sample_size"))

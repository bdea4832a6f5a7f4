"""Jobs that judge vector tables and join the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.operators import anomaly, clustering, histogram, probe, projection, report, retrieval
from textrep.operators.classification import confusion_wide
from textrep.plans.encode import read_run_summary
from textrep.session import spread
from textrep.sources.reviews import label_column
from textrep.sources.runlogs import encoder_runtimes, progress_labels, read_log_lines
from textrep.sources.store import read_meta, read_metrics, upsert_metrics, write_sorted_csv

TASKS = ("validation", "clustering", "retrieval", "anomaly", "projection", "linear_probe", "efficiency", "summary")
# Up to this number of classes the matrix has a column per class; beyond it, a row per cell.
WIDE_CLASSES = 100


def vector_table(spark: SparkSession, folder: str, encoder: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{encoder}"), "row_id")


def _store(spark: SparkSession, results: str, encoder: str, task: str, row: DataFrame) -> None:
    upsert_metrics(spark, f"{results}/metrics", report.metric_rows(row.withColumn("encoder", F.lit(encoder)), task))


def _label(spark: SparkSession, results: str, encoder: str, task: str, vectors: DataFrame, preferred: str) -> str:
    """The label column that the vectors have; its name is stored beside the metrics of the task."""
    label = label_column(vectors, preferred)
    row = spark.createDataFrame([(encoder, task, label)], "encoder string, task string, label_column string")
    row.coalesce(1).write.mode("overwrite").json(f"{results}/labels/{task}/{encoder}")
    return label


def read_label_columns(spark: SparkSession, results: str) -> DataFrame:
    """``(encoder, task, label_column)`` of the tasks that compare with a label."""
    return spark.read.schema("encoder string, task string, label_column string").option("recursiveFileLookup", "true").json(f"{results}/labels")


def validate(spark: SparkSession, table: str, folder: str, encoders: Sequence[str], results: str) -> DataFrame:
    """Checks written as rows; an analysis should not start unless all hold."""
    found = {e: vector_table(spark, folder, e) for e in encoders}
    metas = {e: read_meta(spark, f"{folder}/{e}") for e in encoders}
    checks = report.validate_inputs(spark.read.parquet(table), found, metas)
    checks.write.mode("overwrite").json(f"{results}/validation")
    return spark.read.schema(checks.schema).json(f"{results}/validation")


def run_clustering(spark: SparkSession, folder: str, encoder: str, results: str, label: str = "category") -> None:
    vectors = vector_table(spark, folder, encoder)
    assigned, scores = clustering.evaluate_clustering(vectors, _label(spark, results, encoder, "clustering", vectors, label))
    assigned.write.mode("overwrite").parquet(f"{results}/clusters/{encoder}")
    _store(spark, results, encoder, "clustering", scores)


def run_retrieval(spark: SparkSession, folder: str, encoder: str, results: str, label: str = "category") -> None:
    vectors = vector_table(spark, folder, encoder)
    scores = retrieval.evaluate_retrieval(vectors, _label(spark, results, encoder, "retrieval", vectors, label))
    _store(spark, results, encoder, "retrieval", scores)


def run_anomaly(spark: SparkSession, table: str, folder: str, encoder: str, results: str, share: float = 0.01) -> None:
    """Score table, the two sorted row reports and the histogram of both scores.

    Texts join only the flagged rows, about a hundredth of the table each.
    """
    target = f"{results}/anomaly/{encoder}"
    scores, thresholds = anomaly.anomaly_table(vector_table(spark, folder, encoder), share)
    scores.write.mode("overwrite").parquet(f"{target}/scores")
    scores = spark.read.parquet(f"{target}/scores")
    texts = spark.read.parquet(table)
    texts = texts.select([c for c in ("row_id", "rating", "category", "title", "cleaned_text") if c in texts.columns])
    for flag, order in (("iso_anomaly", F.col("iso_score").asc()), ("inconsistent", F.col("rating_residual").desc())):
        rows = texts.join(scores.filter(flag), "row_id")
        write_sorted_csv(rows, f"{target}/{flag}", order, F.col("row_id"))
    for column in ("iso_score", "rating_residual"):
        curve = histogram.smoothed(histogram.histogram(scores, column))
        curve.write.mode("overwrite").parquet(f"{target}/histogram_{column}")
    counts = scores.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("iso_anomaly").alias("iso_anomaly_count"),
        F.count_if("inconsistent").alias("inconsistency_count"),
        *[F.lit(v).alias(k) for k, v in thresholds.items()],
    )
    _store(spark, results, encoder, "anomaly", counts)


def run_projection(
    spark: SparkSession, folder: str, encoder: str, results: str, label: str = "category",
    sample_size: int = projection.COMPARISON_SAMPLE, reuse: bool = True,
) -> None:
    """Coordinates of the comparison sample; stored ones of the right size are kept."""
    vectors = vector_table(spark, folder, encoder)
    target = f"{results}/projection/{encoder}"
    wanted = min(sample_size, vectors.count())
    if not (reuse and _stored_rows(spark, target) == wanted):
        clusters = spark.read.parquet(f"{results}/clusters/{encoder}")
        points = projection.comparison(vectors, _label(spark, results, encoder, "projection", vectors, label), clusters, sample_size)
        points.write.mode("overwrite").parquet(target)
    stored = spark.read.parquet(target)
    _store(spark, results, encoder, "projection", stored.agg(F.count(F.lit(1)).alias("sample_size")))


def _stored_rows(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.parquet(path).count()
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def run_probe(spark: SparkSession, folder: str, encoder: str, results: str, target: str = "rating") -> None:
    table, scores = probe.evaluate_probe(vector_table(spark, folder, encoder), target)
    classes = [r.truth for r in table.select("truth").distinct().orderBy("truth").limit(WIDE_CLASSES + 1).collect()]
    if len(classes) <= WIDE_CLASSES:
        write_sorted_csv(confusion_wide(table, classes), f"{results}/confusion/{encoder}", "truth")
    else:
        write_sorted_csv(table, f"{results}/confusion/{encoder}", "truth", "pred")
    _store(spark, results, encoder, "linear_probe", scores)


def run_efficiency(spark: SparkSession, folder: str, encoders: Sequence[str], results: str, logs: str | None = None) -> DataFrame:
    metas = [
        read_meta(spark, f"{folder}/{e}").select(F.lit(e).alias("encoder"), F.col("rows_written").alias("rows"), "dim")
        for e in encoders
    ]
    meta = metas[0]
    for part in metas[1:]:
        meta = meta.unionByName(part)
    if logs:
        times = encoder_runtimes(read_log_lines(spark, logs), progress_labels(encoders))
    else:
        times = spark.createDataFrame([], "encoder string, elapsed string, elapsed_seconds double, source string")
    rows = report.efficiency(meta, read_run_summary(spark, folder), times)
    rows.write.mode("overwrite").json(f"{results}/efficiency")
    return spark.read.schema(rows.schema).json(f"{results}/efficiency")


def run_summary(spark: SparkSession, folder: str, encoders: Sequence[str], results: str, logs: str | None = None) -> DataFrame:
    efficiency = run_efficiency(spark, folder, encoders, results, logs)
    listed = spark.createDataFrame([(e,) for e in encoders], "encoder string")
    paths = spark.createDataFrame([(e, f"{results}/projection/{e}") for e in encoders], "encoder string, coords_path string")
    table = report.summary(listed, efficiency, read_metrics(spark, f"{results}/metrics"), paths)
    write_sorted_csv(table, f"{results}/summary", "encoder")
    return table

"""Input checks, efficiency figures and the joined summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textrep.functions.formats import human_bytes
from textrep.schema import METRIC_SCHEMA, REQUIRED_COLUMNS
from textrep.sources.runlogs import CLOCK_SOURCE, TIMER_SOURCE

# Metric names that are settings, encoders that run without a GPU,
# and the row gates of a sample and a full run.
NOT_A_SCORE = ("label_column", "n_clusters", "query_sample_size", "silhouette_sample_size")
CPU_ENCODERS = ("tfidf", "w2v", "glove", "w2v_trained", "glove_trained")
SAMPLE_ROWS, FULL_ROWS = 100, 1_000_000


def require_rows(df: DataFrame, minimum: int = SAMPLE_ROWS) -> int:
    """Row count, or an error below the minimum."""
    rows = df.count()
    if rows < minimum:
        raise ValueError(f"only {rows} rows, at least {minimum} are needed")
    return rows


def align(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """One-to-one join on the row id; keys of one side only, or repeated ones, are an error."""
    found = check_alignment(left, right, key).first()
    if not found["ok"]:
        raise ValueError(f"the tables do not match: {found.asDict()}")
    return left.join(right, key)


def check_alignment(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: row counts of both sides, keys found on one side only, and a verdict."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_key = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.expr("r = 0")).alias("only_left"),
        F.count_if(F.expr("l = 0")).alias("only_right"),
        F.count_if(F.expr("l > 1 or r > 1")).alias("repeated"),
        F.coalesce(F.every(F.expr("l = 1 and r = 1")), F.lit(True)).alias("ok"),
    )


def validate_inputs(
    table: DataFrame, embeddings: dict[str, DataFrame | None], metas: dict[str, DataFrame],
    required: Sequence[str] = REQUIRED_COLUMNS,
) -> DataFrame:
    """``(encoder, check, expected, actual, ok)``: one row per expectation.

    Every figure is an aggregate in the plan; nothing is read to the driver.
    """
    spark = table.sparkSession
    rows = table.agg(F.count(F.lit(1)).cast("string").alias("expected"))
    checks = [
        table.limit(0).agg(
            F.lit("table").alias("encoder"), F.lit(f"column {c}").alias("check"), F.lit("present").alias("expected"),
            F.lit("present" if c in table.columns else "missing").alias("actual"),
        )
        for c in required
    ]
    for encoder, vectors in embeddings.items():
        if vectors is None:
            checks.append(
                spark.range(1).select(
                    F.lit(encoder).alias("encoder"), F.lit("embedding").alias("check"),
                    F.lit("present").alias("expected"), F.lit("missing").alias("actual"),
                )
            )
            continue
        found = vectors.agg(
            F.count(F.lit(1)).cast("string").alias("rows"), F.max(F.size("embedding")).cast("string").alias("dim")
        )
        meta = metas[encoder].agg(
            F.coalesce(F.max("total_rows").cast("string"), F.lit("missing")).alias("total_rows"),
            F.coalesce(F.max("rows_written").cast("string"), F.lit("missing")).alias("rows_written"),
            F.coalesce(F.max("dim").cast("string"), F.lit("missing")).alias("meta_dim"),
            F.coalesce(F.max("complete").cast("string"), F.lit("missing")).alias("complete"),
        )
        name = F.lit(encoder).alias("encoder")

        def against(expected: DataFrame, expected_column: str, actual: DataFrame, pairs: dict[str, str]) -> DataFrame:
            """Both sides are one row; they meet in one row through a union."""
            both = expected.select(F.col(expected_column).alias("e")).unionByName(
                actual.select(F.array(*[F.struct(F.lit(c).alias("check"), F.col(a).alias("actual")) for c, a in pairs.items()]).alias("a")),
                allowMissingColumns=True,
            ).agg(F.max("e").alias("expected"), F.max("a").alias("a"))
            return both.select("expected", F.explode("a").alias("x")).select(
                name, F.col("x.check").alias("check"), "expected", F.col("x.actual").alias("actual")
            )

        checks.append(against(rows, "expected", found, {"rows": "rows"}))
        checks.append(against(rows, "expected", meta, {"meta total_rows": "total_rows", "meta rows_written": "rows_written"}))
        checks.append(against(found, "dim", meta, {"meta dim": "meta_dim"}))
        checks.append(meta.select(name, F.lit("meta complete").alias("check"), F.lit("true").alias("expected"), F.col("complete").alias("actual")))
    result = checks[0]
    for part in checks[1:]:
        result = result.unionByName(part)
    return result.withColumn("ok", F.col("expected") == F.col("actual"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: overall result and the failed checks as sorted messages."""
    message = F.concat_ws(" ", "encoder", F.lit(":"), "check", F.lit("expected"), "expected", F.lit("got"), "actual")
    return checks.agg(
        F.every("ok").alias("ok"), F.sort_array(F.collect_list(F.when(~F.col("ok"), message))).alias("errors")
    )


def score_rows(wide: DataFrame, key: str = "encoder") -> DataFrame:
    """``(encoder, metric, score)`` of the numeric, finite scores of a wide table."""
    numeric = [
        f.name for f in wide.schema.fields
        if f.name != key and f.name not in NOT_A_SCORE
        and f.dataType.typeName() in ("integer", "long", "float", "double", "short", "byte")
    ]
    doubles = wide.select(key, *[F.col(c).cast("double").alias(c) for c in numeric])
    long_form = doubles.unpivot([key], numeric, "metric", "score")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    return long_form.filter(finite).withColumn("metric", F.upper("metric"))


def metric_rows(wide: DataFrame, task: str, key: str = "encoder") -> DataFrame:
    """A wide one-row-per-encoder result as metric rows."""
    names = [f.name for f in wide.schema.fields if f.name != key and f.dataType.typeName() not in ("string", "array", "boolean")]
    doubles = wide.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    return doubles.unpivot([key], names, "metric", "value").select(
        F.upper(key).alias("encoder"), F.lit(task).alias("task"), "metric", "value"
    ).select(*METRIC_SCHEMA.names)


def payload_bytes(rows: Column, dim: Column) -> Column:
    """Size of the vectors as 32-bit floats."""
    return rows.cast("long") * dim.cast("long") * 4


def efficiency(meta: DataFrame, run_summary: DataFrame, log_runtimes: DataFrame) -> DataFrame:
    """One row per encoder: size, device and run time.

    The wall-clock line of a log comes first, then the timer of the run, then a
    progress bar. All inputs have one row per encoder.
    """
    run = run_summary.select(
        "encoder", F.col("elapsed").alias("run_elapsed"), F.col("elapsed_seconds").alias("run_seconds"),
        F.col("device").alias("run_device"),
    )
    log = log_runtimes.select(
        "encoder", F.col("elapsed").alias("log_elapsed"), F.col("elapsed_seconds").alias("log_seconds"),
        F.col("source").alias("log_source"),
    )
    joined = meta.join(run, "encoder", "left").join(log, "encoder", "left")
    use_log = F.coalesce(F.col("log_source") == CLOCK_SOURCE, F.lit(False)) | F.col("run_elapsed").isNull()
    size = payload_bytes(F.col("rows"), F.col("dim"))
    return joined.select(
        "encoder", "rows", "dim", size.alias("bytes"), human_bytes(size).alias("file_size"),
        (size / F.greatest(F.col("rows"), F.lit(1))).alias("bytes_per_row"),
        F.coalesce("run_device", F.when(F.lower("encoder").isin(*CPU_ENCODERS), "cpu")).alias("device"),
        F.when(use_log, F.col("log_elapsed")).otherwise(F.col("run_elapsed")).alias("elapsed"),
        F.when(use_log, F.col("log_seconds")).otherwise(F.col("run_seconds")).alias("elapsed_seconds"),
        F.when(use_log, F.col("log_source")).otherwise(F.lit(TIMER_SOURCE)).alias("source"),
    )


# Summary column -> (task, metric).
SUMMARY_METRICS = {
    "cluster_nmi": ("clustering", "nmi"),
    "cluster_ari": ("clustering", "ari"),
    "silhouette": ("clustering", "silhouette"),
    "retrieval_mrr": ("retrieval", "mrr"),
    "precision@5": ("retrieval", "precision_5"),
    "precision@10": ("retrieval", "precision_10"),
    "precision@50": ("retrieval", "precision_50"),
    "iso_anomalies": ("anomaly", "iso_anomaly_count"),
    "inconsistencies": ("anomaly", "inconsistency_count"),
    "linear_accuracy": ("linear_probe", "accuracy"),
    "linear_macro_f1": ("linear_probe", "macro_f1"),
    "linear_weighted_f1": ("linear_probe", "weighted_f1"),
    "umap_sample_size": ("projection", "sample_size"),
}
COUNTS = ("iso_anomalies", "inconsistencies", "umap_sample_size")


def summary(encoders: DataFrame, efficiency_rows: DataFrame, metrics: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Twenty columns per encoder; what is missing stays null.

    The metric rows are pivoted in one aggregation instead of one join per task.
    """
    wide = metrics.groupBy(F.upper("encoder").alias("encoder")).agg(
        *[
            F.max(F.when((F.col("task") == t) & (F.col("metric") == m), F.col("value")))
            .cast("long" if name in COUNTS else "double").alias(name)
            for name, (t, m) in SUMMARY_METRICS.items()
        ]
    )
    eff = efficiency_rows.select(
        F.upper("encoder").alias("encoder"), "rows", "dim", "file_size", "device", F.col("elapsed").alias("embed_elapsed")
    )
    paths = coordinates.select(F.upper("encoder").alias("encoder"), F.col("coords_path").alias("umap_coords"))
    listed = encoders.select(F.upper("encoder").alias("encoder")).distinct()
    joined = listed.join(eff, "encoder", "left").join(wide, "encoder", "left").join(paths, "encoder", "left")
    return joined.select(
        "encoder", "rows", "dim", "file_size", "device", "embed_elapsed",
        *[F.col(f"`{name}`") for name in SUMMARY_METRICS], "umap_coords",
    )

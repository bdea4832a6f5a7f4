"""Command-line driver: raw files to cleaned table, vectors, analyses, summary.

    spark-submit textrep/plans/job.py --raw RAW --out OUT [--stages ...] [--tasks ...]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from textrep.operators.encoders import batch, glove, tfidf, w2v
from textrep.operators.report import SAMPLE_ROWS, require_rows, verdict
from textrep.plans import analyse, encode
from textrep.plans.preprocess import preprocess
from textrep.session import spread

STAGES = ("preprocess", "embeddings", "analysis")


def default_builds(
    texts: DataFrame, models: str, word_vectors: dict[str, str] | None = None, make_encoders: dict | None = None,
    size: int = 300, epochs: int | None = None, max_features: int = tfidf.MAX_FEATURES, min_count: int = 5,
) -> dict:
    """The trained and built-in encoders, plus one per word-vector file and batch model."""
    builds = {
        "tfidf": (encode.tfidf_build(texts, models, size, max_features), size),
        "w2v_trained": (encode.w2v_build(texts, models, size, epochs or w2v.EPOCHS, min_count, w2v.WINDOW), size),
        "glove_trained": (
            encode.glove_build(texts, models, size, epochs or glove.EPOCHS, min_count, glove.WINDOW, glove.MAX_VOCAB), size
        ),
        "hashing": (encode.batch_build(texts, batch.hashing_encoder()), batch.HASH_DIM),
    }
    for name, source in (word_vectors or {}).items():
        builds[name] = (encode.pretrained_build(texts, source, size), size)
    for name, (make_encoder, dim) in (make_encoders or {}).items():
        builds[name] = (encode.batch_build(texts, make_encoder), dim)
    return builds


def run(
    spark: SparkSession, raw: str, out: str, stages=STAGES, tasks=analyse.TASKS, encoders=None, force: bool = False,
    rows_per_category: int | None = None, minimum_rows: int = SAMPLE_ROWS, logs: str | None = None, **build_options,
) -> DataFrame | None:
    """Run the chosen stages; returns the summary when it was asked for."""
    table, folder, results = f"{out}/cleaned", f"{out}/embeddings", f"{out}/results"
    if "preprocess" in stages:
        preprocess(spark, raw, table, rows_per_category=rows_per_category)
    require_rows(spark.read.parquet(table), minimum_rows)
    texts = spread(spark.read.parquet(table), "row_id")
    builds = default_builds(texts, f"{out}/models", **build_options)
    encoders = list(encoders or builds)
    if "embeddings" in stages:
        done = encode.encode_all(spark, table, folder, {e: builds[e] for e in encoders}, force)
        missing = {row.encoder for row in done.filter("skipped").collect()}
        encoders = [e for e in encoders if e not in missing]
    if "analysis" not in stages:
        return None
    if "validation" in tasks:
        found = verdict(analyse.validate(spark, table, folder, encoders, results)).first()
        if not found.ok:
            raise RuntimeError("; ".join(found.errors))
    for encoder in encoders:
        if "clustering" in tasks:
            analyse.run_clustering(spark, folder, encoder, results)
        if "retrieval" in tasks:
            analyse.run_retrieval(spark, folder, encoder, results)
        if "anomaly" in tasks:
            analyse.run_anomaly(spark, table, folder, encoder, results)
        if "projection" in tasks:
            analyse.run_projection(spark, folder, encoder, results)
        if "linear_probe" in tasks:
            analyse.run_probe(spark, folder, encoder, results)
        spark.catalog.clearCache()
    if "summary" in tasks:
        return analyse.run_summary(spark, folder, encoders, results, logs)
    if "efficiency" in tasks:
        analyse.run_efficiency(spark, folder, encoders, results, logs)
    return None


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--raw", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--stages", nargs="+", choices=STAGES, default=STAGES)
    parser.add_argument("--tasks", nargs="+", choices=analyse.TASKS, default=analyse.TASKS)
    parser.add_argument("--encoders", nargs="+")
    parser.add_argument("--rows-per-category", type=int)
    parser.add_argument("--minimum-rows", type=int, default=SAMPLE_ROWS)
    parser.add_argument("--logs")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("textrep").getOrCreate()
    run(
        spark, args.raw, args.out, args.stages, args.tasks, args.encoders, args.force, args.rows_per_category,
        args.minimum_rows, args.logs,
    )


if __name__ == "__main__":
    main()

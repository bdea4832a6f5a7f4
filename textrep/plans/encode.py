"""Job that turns the cleaned table into one vector table per encoder."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.functions.formats import elapsed_text
from textrep.functions.text import tokens
from textrep.functions.vectors import list_array, matrix
from textrep.operators import vocab
from textrep.operators.encoders import batch, glove, mean, tfidf, w2v
from textrep.sources.store import materialize, overlay, read_latest, write_next
from textrep.sources.wordvectors import read_word_vectors

# The vector table carries the columns that the analyses compare with, as far as the texts have them.
KEEP = ("row_id", "category", "rating")
RUN_SCHEMA = "encoder string, elapsed string, elapsed_seconds double, device string, reused boolean, skipped boolean"

Build = Callable[[], DataFrame]


def kept(texts: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in KEEP if c in texts.columns)


def save_svd(spark: SparkSession, svd: tfidf.Svd, path: str) -> None:
    """Components as one row per word id, singular values next to them."""
    rows = pa.table({
        "word": pa.array(np.arange(len(svd.components)), pa.int32()),
        "loadings": list_array(svd.components, pa.float64()),
    })
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{path}/components")
    values = [(i, float(v)) for i, v in enumerate(svd.singular_values)]
    spark.createDataFrame(values, "component int, value double").write.mode("overwrite").parquet(f"{path}/values")


def load_svd(spark: SparkSession, path: str) -> tfidf.Svd:
    rows = spark.read.parquet(f"{path}/components").orderBy("word").toArrow()
    values = spark.read.parquet(f"{path}/values").orderBy("component").toArrow()
    return tfidf.Svd(matrix(rows.column(1)), values.column(1).to_numpy())


def tfidf_build(texts: DataFrame, models: str, components: int, max_features: int) -> Build:
    def build() -> DataFrame:
        rows, model, svd = tfidf.encode(texts, components, max_features, text="cleaned_text", keep=kept(texts))
        model.write().overwrite().save(f"{models}/tfidf/weights")
        save_svd(texts.sparkSession, svd, f"{models}/tfidf/svd")
        return rows

    return build


class SourceMissing(Exception):
    """The word vectors of an encoder are not there."""


def pretrained_build(texts: DataFrame, source: str, size: int) -> Build:
    def build() -> DataFrame:
        words = vocab.vocabulary(texts, tokens("cleaned_text"))
        try:
            vectors = read_word_vectors(texts.sparkSession, source, size, words).persist()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise SourceMissing(source) from error
        mean.check_dimension(vectors, size)
        return mean.encode(texts, tokens("cleaned_text"), vectors, size, kept(texts))

    return build


def w2v_build(texts: DataFrame, models: str, size: int, epochs: int, min_count: int, window: int) -> Build:
    def build() -> DataFrame:
        model = w2v.train(texts, size, window, min_count, epochs)
        model.vectors.write.mode("overwrite").parquet(f"{models}/w2v_trained/vectors")
        return w2v.encode(texts, model, keep=kept(texts))

    return build


def glove_build(
    texts: DataFrame, models: str, size: int, epochs: int, min_count: int, window: int, max_vocab: int,
    max_tokens: int | None = None,
) -> Build:
    def build() -> DataFrame:
        listed = texts.select("row_id", tokens("cleaned_text").alias("tokens"))
        top = vocab.ranked_vocabulary(vocab.token_counts(listed, "tokens"), max_vocab, min_count).persist()
        read = F.slice("tokens", 1, max_tokens) if max_tokens else F.col("tokens")
        cells = vocab.cooccurrence(vocab.token_ids(listed, read, top), window)
        model = glove.train(cells, top.count(), size, epochs)
        path = f"{models}/glove_trained"
        glove.word_vectors(model, top).write.mode("overwrite").parquet(f"{path}/vectors")
        spark = texts.sparkSession
        losses = spark.createDataFrame(list(enumerate(model.losses, 1)), "sweep int, loss double")
        losses.write.mode("overwrite").json(f"{path}/losses")
        vectors = spark.read.parquet(f"{path}/vectors")
        return mean.encode(texts, tokens("cleaned_text"), vectors, size, kept(texts))

    return build


def batch_build(texts: DataFrame, make_encoder) -> Build:
    return lambda: batch.encode(texts, make_encoder, keep=kept(texts))


def encode_all(
    spark: SparkSession, table: str, folder: str, builds: dict[str, tuple[Build, int]], force: bool = False,
    devices: dict[str, str] | None = None,
) -> DataFrame:
    """Build or reuse every vector table; returns the updated run summary.

    ``builds`` maps an encoder to its build function and its width. A reused
    table keeps its earlier run time, and an encoder whose word vectors are not
    there is recorded as skipped.
    """
    total = spark.read.parquet(table).count()
    rows = []
    for encoder, (build, dim) in builds.items():
        start = time.perf_counter()
        try:
            reused = materialize(
                spark, f"{folder}/{encoder}", encoder, total, dim, build, force, at_most=encoder == "tfidf"
            )[1]
        except SourceMissing:
            rows.append((encoder, None, None, False, True))
            continue
        seconds = None if reused else round(time.perf_counter() - start, 2)
        rows.append((encoder, seconds, (devices or {}).get(encoder), reused, False))
    timed = spark.createDataFrame(
        rows, "encoder string, elapsed_seconds double, device string, reused boolean, skipped boolean"
    )
    new = timed.withColumn("elapsed", elapsed_text(F.col("elapsed_seconds")))
    path = f"{folder}/run_summary"
    old, version = read_latest(spark, path, RUN_SCHEMA)
    write_next(overlay(old, new, ("encoder",)), path, version)
    return read_run_summary(spark, folder)


def read_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return read_latest(spark, f"{folder}/run_summary", RUN_SCHEMA)[0]

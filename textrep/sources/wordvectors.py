"""Word vectors as text lines ``word v1 ... vN``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_word_vectors(spark: SparkSession, path: str, size: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(token, vector)``; a word may hold blanks, its last line wins.

    Lines with too few fields are skipped. With a vocabulary only its tokens
    are kept, before the numbers are read.
    """
    lines = spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"),
        F.split(F.rtrim("value"), " ").alias("parts"),
    )
    return parse_word_vectors(lines, size, vocabulary)


def parse_word_vectors(lines: DataFrame, size: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """The same from ``(at, parts)``: sortable line position and blank-separated fields."""
    width = F.size("parts")
    words = lines.filter(width >= size + 1).select(
        "at",
        F.array_join(F.slice("parts", F.lit(1), width - size), " ").alias("token"),
        F.slice("parts", width - size + 1, F.lit(size)).alias("fields"),
    )
    if vocabulary is not None:
        words = words.join(vocabulary.select("token").distinct(), "token", "left_semi")
    last = words.groupBy("token").agg(F.max_by("fields", "at").alias("fields"))
    return last.select("token", F.transform("fields", lambda x: x.cast("float")).alias("vector"))


def write_word_vectors(vectors: DataFrame, path: str) -> None:
    """The text form of ``(token, vector)``."""
    numbers = F.array_join(F.transform("vector", lambda x: x.cast("string")), " ")
    vectors.select(F.concat_ws(" ", "token", numbers).alias("value")).write.mode("overwrite").text(path)

"""Jobs from raw review files to the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.functions.text import MIN_LENGTH, first_tokens, long_enough
from textrep.operators.dedup import first_of_each
from textrep.operators.preprocess import drop_counts, evaluated_once
from textrep.operators.sampling import first_per_group
from textrep.schema import CLEANED_SCHEMA
from textrep.sources.reviews import POSITION, normalize, read_reviews, write_table


def _write_kept(kept: DataFrame, output: str, overwrite: bool) -> None:
    write_table(kept.select("row_id", *CLEANED_SCHEMA.names), output, overwrite)


def preprocess(
    spark: SparkSession, raw_folder: str, output: str, min_length: int = MIN_LENGTH,
    max_tokens: int | None = None, deduplicate: bool = True, overwrite: bool = True,
    rows_per_category: int | None = None,
) -> DataFrame:
    """Write the cleaned table and its counts; returns the counts per category.

    The rows are counted by aggregates of their own, so a task that runs twice
    counts nothing twice. With ``rows_per_category`` the first rows of each
    category are written.
    """
    cleaned = evaluated_once(normalize(read_reviews(spark, raw_folder)), "cleaned_text")
    kept = cleaned.filter(long_enough("cleaned_text", min_length))
    if deduplicate:
        kept = first_of_each(kept, list(POSITION))
    if rows_per_category is not None:
        kept = first_per_group(kept, "category", list(POSITION), rows_per_category)
    _write_kept(kept.withColumn("cleaned_text", first_tokens("cleaned_text", max_tokens)), output, overwrite)
    counts = drop_counts(cleaned, spark.read.parquet(output), min_length).persist()
    total = counts.agg(*[F.sum(c).alias(c) for c in counts.columns[1:]])
    if not total.first().kept_rows:
        raise RuntimeError("no rows are left after cleaning")
    totals = total if rows_per_category is None else total.withColumn("dropped_duplicates", F.lit(None).cast("long"))
    totals.write.mode("overwrite").json(f"{output}.summary/totals")
    shown = counts.select("category", "raw_rows", "kept_rows")
    shown.write.mode("overwrite").json(f"{output}.summary/categories")
    counts.unpersist()
    return spark.read.schema(shown.schema).json(f"{output}.summary/categories")

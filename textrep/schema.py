"""Table layouts shared by the sources, the operators and the jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# The raw review fields and the ten columns of the cleaned table.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("rating", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("verified_purchase", T.StringType()),
    ]
)

CLEANED_SCHEMA = T.StructType(
    [
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("verified_purchase", T.BooleanType()),
        T.StructField("category", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("cleaned_text", T.StringType()),
    ]
)

DEDUP_KEYS = ("user_id", "parent_asin", "cleaned_text")
REQUIRED_COLUMNS = ("rating", "category", "cleaned_text")

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("encoder", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

EMBEDDING_META_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rows_written", T.LongType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("complete", T.BooleanType()),
    ]
)

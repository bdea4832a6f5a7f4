"""The given tables in the shape the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.functions.text import clean_text
from textrep.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw reviews: language as category, source as user."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return spread(documents, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        (F.pmod("doc_id", F.lit(5)) + 1.0).alias("rating"),
        "text",
        F.col("source").alias("user_id"),
        F.col("lang").alias("category"),
        (F.when(F.pmod("doc_id", F.lit(7)) != 0, F.pmod("doc_id", F.lit(3)) == 0)).alias("verified_purchase"),
    )


def review_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, cleaned_text, ...)`` of every document, uncut and not filtered."""
    raw = raw_reviews(spark, folder)
    return raw.withColumn("cleaned_text", clean_text("text", None))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings, scaled so that distance and angle rank differently.

    ``cluster`` is the place of the largest of the first ten entries and
    ``rating`` a rule on the label and the first entry.
    """
    base = spread(table(spark, folder, "embeddings"), "vec_id")
    scale = (F.pmod("vec_id", F.lit(3)) + 1).cast("double")
    head = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return base.select(
        F.col("vec_id").alias("row_id"),
        "label",
        F.transform("embedding", lambda x: x.cast("double") * scale).alias("embedding"),
        (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("cluster"),
        (1.0 + F.pmod("label", F.lit(5))).alias("rating"),
    )


# SQL text shared by the oracles.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def sql_squeeze(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}', ' ', 'g'), ' ')"


def sql_tokens(squeezed: str) -> str:
    return f"[t FOR t IN string_split({squeezed}, ' ') IF t <> '']"


def sql_clean(column: str, by: str = " ") -> str:
    untagged = f"regexp_replace(coalesce({column}, ''), '<[^\\n]*?>', '{by}', 'g')"
    return sql_squeeze(untagged)


def sql_cut(column: str, tokens: int = 256) -> str:
    return f"array_to_string(string_split({column}, ' ')[1:{tokens}], ' ')"


RAW_SQL = """
raw AS (SELECT doc_id AS row_id, 1.0 + doc_id % 5 AS rating, text, source AS user_id, lang AS category,
               CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 = 0 END AS verified_purchase FROM documents)"""

CLEANED_SQL = f"""{RAW_SQL},
cleaned AS (SELECT *, {sql_clean('text')} AS cleaned_text FROM raw),
long_enough AS (SELECT * FROM cleaned WHERE length(cleaned_text) >= 10),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cleaned_text ORDER BY row_id) AS copy
                        FROM long_enough) WHERE copy = 1)"""

TOKENS_SQL = f"""{RAW_SQL},
texts AS (SELECT row_id, category, {sql_clean('text')} AS cleaned_text FROM raw),
split AS (SELECT row_id, category, [t FOR t IN string_split(cleaned_text, ' ') IF t <> ''] AS toks FROM texts),
tok AS (SELECT row_id, category, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM split)"""

VECTORS_SQL = """
vec AS (SELECT vec_id AS row_id, label, 1.0 + label % 5 AS rating,
               [x::DOUBLE * (vec_id % 3 + 1) FOR x IN embedding] AS embedding,
               CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INTEGER) AS cluster
        FROM embeddings)"""


def sql_hash(key: str, seed: int = 42) -> str:
    return f"substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 15)"

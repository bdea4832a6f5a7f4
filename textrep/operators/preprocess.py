"""Cleaning, length filter and duplicate removal, with their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrep.functions.text import MIN_LENGTH, first_tokens, long_enough
from textrep.operators.dedup import first_of_each
from textrep.sources.reviews import normalize


def evaluated_once(df: DataFrame, column: str) -> DataFrame:
    """The column as a generator's output.

    A filter on a computed column is normally moved below the projection, which
    computes the column a second time for the filter; it cannot be moved below
    a generator. Cleaning is the costly part of the job, so this halves it.
    """
    one = F.explode(F.array(column)).alias(column)
    return df.select(*[one if c == column else F.col(c) for c in df.columns])


def clean_reviews(
    raw: DataFrame,
    order: list[str],
    min_length: int = MIN_LENGTH,
    max_tokens: int | None = None,
    deduplicate: bool = True,
) -> DataFrame:
    """Clean, drop short texts, keep the first copy of each whole review, then cut if asked."""
    cleaned = evaluated_once(normalize(raw), "cleaned_text")
    kept = cleaned.filter(long_enough("cleaned_text", min_length))
    kept = first_of_each(kept, order) if deduplicate else kept
    return kept.withColumn("cleaned_text", first_tokens("cleaned_text", max_tokens))


def clean_reviews_legacy(
    raw: DataFrame, order: list[str], min_length: int = MIN_LENGTH, max_tokens: int | None = None
) -> DataFrame:
    """Older order: duplicates go first, then short texts, then the cut; tags leave no blank."""
    kept = first_of_each(normalize(raw, None, tag=""), order)
    return kept.filter(long_enough("cleaned_text", min_length)).withColumn(
        "cleaned_text", first_tokens("cleaned_text", max_tokens)
    )


def drop_counts(cleaned: DataFrame, kept: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Raw, short, duplicate and kept rows of every category.

    Each side is counted with map-side partial sums; only one row per category
    and branch is combined.
    """
    zero = F.lit(0).cast("long")
    scanned = cleaned.groupBy("category").agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(~long_enough("cleaned_text", min_length)).alias("dropped_short"),
        zero.alias("kept_rows"),
    )
    left = kept.groupBy("category").agg(
        zero.alias("raw_rows"), zero.alias("dropped_short"), F.count(F.lit(1)).alias("kept_rows")
    )
    total = scanned.unionByName(left).groupBy("category").agg(
        *[F.sum(c).alias(c) for c in ("raw_rows", "dropped_short", "kept_rows")]
    )
    return total.withColumn("dropped_duplicates", F.expr("raw_rows - dropped_short - kept_rows"))


def preprocess_statistics(raw: DataFrame, order: list[str], min_length: int = MIN_LENGTH) -> DataFrame:
    """Counts of the rows that cleaning keeps and drops."""
    cleaned = evaluated_once(normalize(raw), "cleaned_text")
    return drop_counts(cleaned, first_of_each(cleaned.filter(long_enough("cleaned_text", min_length)), order), min_length)

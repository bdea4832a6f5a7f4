"""Exact duplicate removal that keeps the first copy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrep.schema import DEDUP_KEYS


def key_columns(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> list[Column]:
    """The keys with null read as the empty string."""
    nullable = {field.name for field in df.schema.fields if field.nullable}
    return [F.coalesce(F.col(k), F.lit("")) if k in nullable else F.col(k) for k in keys]


def key_hash(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> Column:
    return F.xxhash64(*key_columns(df, keys))


def first_of_each(
    df: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = DEDUP_KEYS
) -> DataFrame:
    """One row per key: the first in ``order``.

    The hash only leads the sort, so most comparisons end at a long; the keys
    themselves decide equality. The rank filter makes every map task keep one
    row per key before the shuffle, so a key held by a third of all rows
    reaches its reducer as one row per map task.
    """
    window = Window.partitionBy(key_hash(df, keys), *key_columns(df, keys)).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(window)).filter("_copy = 1").drop("_copy")


def unseen(new: DataFrame, existing: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """Rows of ``new`` whose key is not yet in ``existing``.

    The existing side is reduced to distinct keys first, so a hot key there
    costs one row.
    """
    names = [f"_seen_{i}" for i in range(len(keys))]
    old = existing.select(
        key_hash(existing, keys).alias("_seen_hash"),
        *[c.alias(n) for c, n in zip(key_columns(existing, keys), names)],
    ).distinct()
    condition = F.col("_key_hash") == F.col("_seen_hash")
    for column, name in zip(key_columns(new, keys), names):
        condition = condition & (column == F.col(name))
    return new.withColumn("_key_hash", key_hash(new, keys)).join(old, condition, "left_anti").drop("_key_hash")


def first_unseen(
    new: DataFrame, existing: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = DEDUP_KEYS
) -> DataFrame:
    """Incremental load: the first copy of every key that is not yet loaded.

    Copies are removed before the join, so that a hot key among the new rows
    is one row when it is shuffled.
    """
    return unseen(first_of_each(new, order, keys), existing, keys)

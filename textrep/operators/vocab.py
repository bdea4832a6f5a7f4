"""Token counts, vocabularies and co-occurrence counts."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.session import cut_lineage

# A vocabulary above this size is joined instead of being sent to every task.
LOOKUP_LIMIT = 200_000


def token_counts(df: DataFrame, tokens: str | Column) -> DataFrame:
    """Occurrences of every token; map tasks combine before the shuffle."""
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("cnt"))


def vocabulary(df: DataFrame, tokens: str | Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).distinct()


def _count_floor(counts: DataFrame, max_vocab: int) -> int:
    """Smallest count that can still be among the ``max_vocab`` most frequent."""
    per_count = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, -1))
    row = (
        per_count.withColumn("_above", F.coalesce(above, F.lit(0)))
        .filter(F.col("_above") < max_vocab)
        .agg(F.min("cnt"))
        .first()
    )
    return row[0]


def ranked_vocabulary(counts: DataFrame, max_vocab: int, min_count: int = 1) -> DataFrame:
    """``(token, cnt, id)``: ids follow falling count, then the token.

    A cheap count-of-counts first finds the smallest count that can make the
    list, so the final ordered limit sees little more than its own size.
    """
    kept = counts.filter(F.col("cnt") >= min_count)
    if max_vocab > 0:
        kept = kept.persist()
        floor = _count_floor(kept, max_vocab)
        if floor is None:
            raise ValueError("the vocabulary is empty; lower min_count")
        order = [F.col("cnt").desc(), F.col("token")]
        top = kept.filter(F.col("cnt") >= floor).orderBy(*order).limit(max_vocab)
        return top.withColumn("id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    return _dense_ids(kept)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place, from 0, in an order without ties.

    Rows are dealt by ranges of the order and ranked inside them, and the sizes
    of the ranges before are added; only one row per range meets in one task.
    The ranges are written, because a repeated deal could cut them elsewhere.
    """
    dealt = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    placed = dealt.withColumn("_rank", rank).join(offsets, "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_rank")).alias(name))


def _dense_ids(kept: DataFrame) -> DataFrame:
    """Ids for a vocabulary without a cap."""
    ids = numbered(kept, [F.col("cnt").desc(), F.col("token")], "id")
    return ids.select("token", "cnt", F.col("id").cast("int").alias("id"))


def coverage(corpus: DataFrame, known: DataFrame) -> DataFrame:
    """How many of the corpus tokens have a vector."""
    hit = known.select("token").distinct().withColumn("_hit", F.lit(True))
    return corpus.select("token").join(hit, "token", "left").agg(
        F.count_if(F.col("_hit").isNotNull()).alias("covered_words"), F.count(F.lit(1)).alias("vocabulary_size")
    )


def token_lookup(spark, vocab: DataFrame):
    """Array expression builder: tokens to ids, unknown tokens dropped.

    Only for a vocabulary whose size was checked against ``LOOKUP_LIMIT``.
    """
    table = vocab.orderBy("id").select("token").toArrow()
    shared = spark.sparkContext.broadcast(table.column(0).combine_chunks().cast(pa.large_string()))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(tokens: pd.Series) -> pd.Series:
        lists = pa.array(tokens, pa.large_list(pa.large_string()))
        found = pc.index_in(lists.flatten(), value_set=shared.value).to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        rows = (found[a:b] for a, b in zip(offsets[:-1], offsets[1:]))
        return pd.Series([row[row == row].astype("int32") for row in rows])

    return ids


def token_ids(df: DataFrame, tokens: str | Column, vocab: DataFrame, key: str = "row_id") -> DataFrame:
    """``(key, ids)``: the known tokens of every row, in order, as ids."""
    listed = df.select(key, (F.col(tokens) if isinstance(tokens, str) else tokens).alias("tokens"))
    size = vocab.count()
    if size <= LOOKUP_LIMIT:
        return listed.select(key, token_lookup(df.sparkSession, vocab)("tokens").alias("ids"))
    return joined_token_ids(listed, vocab, key)


def joined_token_ids(listed: DataFrame, vocab: DataFrame, key: str = "row_id", salts: int = 32) -> DataFrame:
    """The same for a vocabulary of any size: a salted join, so that the rows of
    one frequent token are spread over ``salts`` tasks."""
    spread = F.pmod(F.xxhash64(key, "pos"), F.lit(salts)).cast("int")
    left = listed.select(key, F.posexplode("tokens").alias("pos", "token")).withColumn("_salt", spread)
    right = vocab.select("token", "id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = left.join(right, ["token", "_salt"])
    grouped = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_hits"))
    rows = listed.select(key).join(grouped, key, "left")
    empty = F.array().cast("array<int>")
    return rows.select(key, F.coalesce(F.col("_hits.id"), empty).alias("ids"))


def cooccurrence(ids: DataFrame, window: int = 5, linear: bool = False) -> DataFrame:
    """``(row_id, col_id, value)``: both directions, weight 1 / distance.

    With ``linear`` the weight falls evenly from 1 to 1 / window, the share of
    windows of a random size that hold a pair. Pairs are counted once under
    their smaller id, in whole parts of a unit, so that the sums do not depend
    on the order of adding.
    """
    unit = window if linear else math.lcm(*range(1, window + 1))
    part = f"cast({window + 1} - d as long)" if linear else f"cast({unit} / d as long)"
    far = ids.select("ids", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("d"))
    count = F.greatest(F.size("ids") - F.col("d"), F.lit(0))
    zipped = F.arrays_zip(F.slice("ids", F.lit(1), count).alias("a"), F.slice("ids", F.col("d") + 1, count).alias("b"))
    pairs = far.select("d", F.inline(zipped).alias("a", "b")).select(
        F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"),
        F.expr(part).alias("part"),
    )
    once = pairs.groupBy("low", "high").agg((F.sum("part") / F.lit(float(unit))).alias("value"))
    same = F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b"), (F.col("value") * 2).alias("v")))
    both = F.array(
        F.struct(F.col("low").alias("a"), F.col("high").alias("b"), F.col("value").alias("v")),
        F.struct(F.col("high").alias("a"), F.col("low").alias("b"), F.col("value").alias("v")),
    )
    return once.select(F.explode(F.when(F.col("low") == F.col("high"), same).otherwise(both)).alias("c")).select(
        F.col("c.a").alias("row_id"), F.col("c.b").alias("col_id"), F.col("c.v").alias("value")
    )


def label_codes(df: DataFrame, label: str, code: str = "code") -> DataFrame:
    """Labels numbered in sorted order from 0; a null label gets -1."""
    labels = df.select(F.col(label).alias("_l")).filter("_l is not null").distinct()
    coded = numbered(labels, [F.col("_l")], "_c").withColumn("_c", F.col("_c").cast("int"))
    return df.join(coded, F.col(label) == F.col("_l"), "left").withColumn(
        code, F.coalesce("_c", F.lit(-1))
    ).drop("_l", "_c")

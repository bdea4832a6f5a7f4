"""Repeatable exact-size samples chosen by the order of a hash of the row id.

No operator here ranks a whole table or a whole label, and no window sees more
than keys: counts per hash prefix lead to the prefix in which the quota ends,
longer prefixes narrow it until few rows share it, and the last wanted hash and
key of each group then flag all rows in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrep.session import cut_lineage

SEED = 42
HASH_DIGITS = 15
# Hexadecimal digits by which a prefix grows: 16**3 = 4,096 counts per group.
STEP = 3
# Rows that may share the last prefix.
FEW = 4096


def hash_order(key: str | Column, seed: int = SEED) -> Column:
    """Fixed-width hexadecimal hash of the seed and the row id."""
    key = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, HASH_DIGITS)


def _beside(rows: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Rows with the figures of their group; without a group that is one row, taken as literals."""
    if group:
        return rows.join(found, group, "left")
    only = found.first()
    return rows.select("*", *[F.lit(only[f.name] if only else None).cast(f.dataType).alias(f.name) for f in found.schema])


def _crossing(counts: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """``(group..., order..., _left, _n)``: the last wanted row of counts per group, and the quota left for it."""
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(*order)) - F.col("_n")
    wanted = counts.withColumn("_left", F.col("_left") - before).filter("_left > 0")
    last = wanted.groupBy(*group).agg(F.max(F.struct(*order, "_left", "_n")).alias("_c"))
    return last.select(*group, "_c.*").filter("_c is not null")


def _cutoffs(rows: DataFrame, quotas: DataFrame | int, group: list[str], few: int) -> DataFrame:
    """``(group..., _stop, _last)`` for rows ``(group..., _k, _h)``: hash and key where each group's quota ends.

    ``_last`` is null where everything below ``_stop`` is wanted.
    """
    found, inside = [], rows
    for digits in range(STEP, HASH_DIGITS + 1, STEP):
        counts = inside.groupBy(*group, F.substring("_h", 1, digits).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        if isinstance(quotas, int):
            counts = counts.withColumn("_left", F.lit(quotas).cast("long"))
        else:
            counts = _beside(counts, quotas, group)
        ends = cut_lineage(_crossing(counts, ["_p"], group), "sample-ends")
        # "g" sorts behind every hexadecimal digit.
        whole = ends.filter("_left >= _n").select(*group, F.concat("_p", F.lit("g")).alias("_stop"))
        found.append(whole.withColumn("_last", F.lit(None).cast(rows.schema["_k"].dataType)))
        quotas = ends.filter("_left < _n").select(*group, F.col("_p").alias("_inside"), "_left")
        inside = _beside(rows, quotas, group).filter(F.col("_h").startswith(F.col("_inside"))).drop("_inside", "_left")
        quotas = quotas.drop("_inside")
        if (ends.filter("_left < _n").agg(F.max("_n")).first()[0] or 0) <= few:
            break
    keys = inside.groupBy(*group, "_h", "_k").agg(F.count(F.lit(1)).alias("_n"))
    ends = _crossing(_beside(keys, quotas, group), ["_h", "_k"], group)
    out = ends.select(*group, F.col("_h").alias("_stop"), F.col("_k").alias("_last"))
    for whole in found:
        out = out.unionByName(whole)
    return cut_lineage(out, "sample-cutoffs")


def mark_quota(
    df: DataFrame,
    quotas: DataFrame | int,
    group: Sequence[str] = (),
    key: str = "row_id",
    seed: int = SEED,
    flag: str = "taken",
    few: int = FEW,
) -> DataFrame:
    """Every row with a flag: among the first ``quota`` of its group in hash order.

    ``quotas`` is one number for all groups or a table ``(group..., quota)``.
    Only groups, keys and hashes are counted; the rows themselves are flagged
    against one cutoff per group and are not shuffled while the cutoffs are few
    enough to be broadcast. Keys are distinct; rows of one key go together. A
    row with a null group is not taken.
    """
    group = list(group)
    order = hash_order(key, seed)
    rows = df.select(*group, F.col(key).alias("_k"), order.alias("_h")).filter("_h is not null")
    goals = quotas if isinstance(quotas, int) else quotas.select(*group, F.col("quota").cast("long").alias("_left"))
    marked = _beside(df.withColumn("_h", order), _cutoffs(rows, goals, group, few), group)
    below = (F.col("_h") < F.col("_stop")) | ((F.col("_h") == F.col("_stop")) & (F.col(key) <= F.col("_last")))
    return marked.select(*df.columns, F.coalesce(below, F.lit(False)).alias(flag))


def take_quota(
    df: DataFrame,
    quotas: DataFrame | int,
    group: Sequence[str] = (),
    key: str = "row_id",
    seed: int = SEED,
) -> DataFrame:
    """The first ``quota`` rows of every group in hash order."""
    return mark_quota(df, quotas, group, key, seed, "_taken").filter("_taken").drop("_taken")


def uniform_sample(df: DataFrame, size: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows without replacement, or all rows when there are fewer."""
    return take_quota(df, size, (), key, seed)


def sample_per_group(df: DataFrame, group: str, size: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """Fixed-size sample of every group."""
    return take_quota(df, size, (group,), key, seed)


# The ratings that own a reservoir of a balanced sample.
RATINGS = (1.0, 2.0, 3.0, 4.0, 5.0)


def balanced_rating_sample(df: DataFrame, size: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """``size // 5`` rows of each rating 1 to 5; other ratings are left out."""
    rated = df.filter(F.col("rating").isin(*RATINGS))
    return sample_per_group(rated, "rating", size // len(RATINGS), key, seed)


def sample_counts(df: DataFrame, sample: DataFrame, group: str = "rating") -> DataFrame:
    """Rows seen and kept per group."""
    seen = df.groupBy(group).agg(F.count(F.lit(1)).alias("seen"), F.lit(0).cast("long").alias("kept"))
    kept = sample.groupBy(group).agg(F.lit(0).cast("long").alias("seen"), F.count(F.lit(1)).alias("kept"))
    return seen.unionByName(kept).groupBy(group).agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept"))


def stratified_quotas(df: DataFrame, label: str, size: int) -> DataFrame:
    """Proportional quotas ``(label, n, quota)`` that add up to ``size``.

    Shares are rounded down; the spare rows go to the largest fractions, and of
    two equal fractions the later label is served first. The windows run over
    one row per label.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    share = counts.withColumn("_share", F.col("n") / total * F.lit(size)).withColumn(
        "_floor", F.floor("_share").cast("long")
    )
    spare = F.lit(size) - F.sum("_floor").over(everything)
    turn = F.row_number().over(Window.orderBy((F.col("_share") - F.col("_floor")).desc(), F.col(label).desc()))
    quota = F.least(F.col("n"), F.col("_floor") + F.when(turn <= spare, 1).otherwise(0))
    return share.select(label, "n", F.when(F.lit(size) >= total, F.col("n")).otherwise(quota).alias("quota"))


def stratified_sample(df: DataFrame, label: str, size: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """Sample of ``size`` rows with every label at its proportional quota."""
    return take_quota(df, stratified_quotas(df, label, size), (label,), key, seed)


def train_test_split(
    df: DataFrame, target: str, test_share: float = 0.2, key: str = "row_id", seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Stratified split with ``ceil(share * n)`` test rows; null targets are dropped."""
    valid = df.filter(F.col(target).isNotNull())
    size = math.ceil(test_share * valid.count())
    marked = mark_quota(valid, stratified_quotas(valid, target, size), (target,), key, seed, "_test")
    return marked.filter(~F.col("_test")).drop("_test"), marked.filter("_test").drop("_test")


def first_per_group(
    df: DataFrame, group: str, order: Sequence[str], size: int, salts: int = 64
) -> DataFrame:
    """The first ``size`` rows of each group in ``order``.

    Two ranks: within (group, salt) first, so a hot group is spread over many
    tasks, then over the at most ``salts * size`` survivors of the group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    inner = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))
    outer = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    few = salted.withColumn("_r", inner).filter(F.col("_r") <= size)
    return few.withColumn("_r", outer).filter(F.col("_r") <= size).drop("_r", "_salt")

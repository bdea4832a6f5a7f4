"""Vector tables on disk with a completion record, metric tables and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.schema import EMBEDDING_META_SCHEMA, METRIC_SCHEMA


def meta_path(path: str) -> str:
    return path.rstrip("/") + ".meta"


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON documents of a folder, or an empty table when there is none."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def write_embeddings(
    df: DataFrame, path: str, kind: str, total_rows: int, dim: int, at_most: bool = False
) -> DataFrame:
    """Write ``(row_id, ..., embedding)`` and then its completion record.

    A vector of another width fails the job while it is written. The record is
    written last, so an interrupted job leaves a table without one; its row
    count comes from the Parquet footers.
    """
    spark = df.sparkSession
    width = F.size("embedding")
    fits = width.between(1, dim) if at_most else width == dim
    problem = F.concat(F.lit(f"{path}: {dim} entries expected, found "), width.cast("string"))
    checked = df.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(problem)))
    spark.createDataFrame([], EMBEDDING_META_SCHEMA).write.mode("overwrite").json(meta_path(path))
    checked.write.mode("overwrite").option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    rows = stored.count()
    first = stored.select(width.alias("n")).first()
    record = (kind, path, rows, total_rows, first.n if first else dim, rows >= total_rows)
    meta = spark.createDataFrame([record], EMBEDDING_META_SCHEMA)
    meta.write.mode("overwrite").json(meta_path(path))
    return meta


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, meta_path(path), EMBEDDING_META_SCHEMA)


def reusable(spark: SparkSession, path: str, total_rows: int, dim: int, at_most: bool = False) -> bool:
    """A complete table with the expected rows and width (or any width up to it)."""
    width = F.col("dim").between(1, dim) if at_most else F.col("dim") == dim
    fits = F.col("complete") & (F.col("total_rows") == total_rows) & (F.col("rows_written") == total_rows) & width
    return bool(read_meta(spark, path).filter(fits).limit(1).count())


def materialize(
    spark: SparkSession, path: str, kind: str, total_rows: int, dim: int, build: Callable[[], DataFrame],
    force: bool = False, at_most: bool = False,
) -> tuple[DataFrame, bool]:
    """The stored table, built only when no fitting one exists; tells if it was reused."""
    reuse = not force and reusable(spark, path, total_rows, dim, at_most)
    if not reuse:
        write_embeddings(build(), path, kind, total_rows, dim, at_most)
    return spark.read.parquet(path), reuse


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows of the same key, all others stay."""
    kept = old.join(new.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def overlay(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per field, the new value where there is one, else the old one."""
    fields = [c for c in dict.fromkeys([*old.columns, *new.columns]) if c not in keys]
    o, n = old.alias("o"), new.alias("n")

    def pick(name: str):
        found = [F.col(f"{side}.{name}") for side, df in (("n", new), ("o", old)) if name in df.columns]
        return F.coalesce(*found).alias(name)

    condition = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return o.join(n, condition, "full").select(
        *[F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys], *[pick(f) for f in fields]
    )


def read_latest(spark: SparkSession, path: str, schema) -> tuple[DataFrame, int]:
    """Rows and number of the newest version of a small table, (empty, 0) when new."""
    empty = spark.createDataFrame([], schema)
    versions = read_or_empty(spark, path, T.StructType([*empty.schema.fields, T.StructField("v", T.IntegerType())]))
    newest = versions.agg(F.max("v")).first()[0]
    return (empty, 0) if newest is None else (versions.filter(F.col("v") == newest).drop("v"), newest)


def write_next(df: DataFrame, path: str, version: int) -> None:
    """The version after ``version``: one file that appears in a single rename."""
    df.coalesce(1).write.mode("overwrite").json(f"{path}/v={version + 1}")


def upsert_metrics(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """Metric rows merged into a stored table; a failed write leaves the last version."""
    old, version = read_latest(spark, path, METRIC_SCHEMA)
    write_next(upsert(old, new.select(*METRIC_SCHEMA.names), ("encoder", "task", "metric")), path, version)
    return read_metrics(spark, path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path, METRIC_SCHEMA)[0]


def write_sorted_csv(df: DataFrame, path: str, *order) -> None:
    """Header CSV whose part files follow each other in the given order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

"""Review files in, cleaned table out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.functions.formats import ANY_FILE_GLOB, REVIEW_FILE_GLOB, category_of_file, file_name
from textrep.functions.text import clean_text
from textrep.schema import CLEANED_SCHEMA, RAW_SCHEMA

POSITION = ("source_file", "block_start", "row_id")


def _scan(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).option("pathGlobFilter", glob).json(folder)


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Sorted review files of a folder: the export layout first, else any JSON lines."""
    for glob in (REVIEW_FILE_GLOB, ANY_FILE_GLOB):
        try:
            files = sorted(_scan(spark, folder, glob).inputFiles())
        except AnalysisException as error:
            raise FileNotFoundError(f"no such folder: {folder}") from error
        if files:
            return files
    raise FileNotFoundError(f"no .jsonl files in {folder}")


def read_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records with ``source_file``, ``block_start`` and ``row_id``.

    A split is read from start to end by one task, so (file, block start, row id)
    is the order of the lines whatever the split size. The row id is fixed once
    the cleaned table is written.
    """
    name = discover(spark, folder)[0].rsplit("/", 1)[-1]
    glob = REVIEW_FILE_GLOB if name.startswith(REVIEW_FILE_GLOB.split("*")[0]) else ANY_FILE_GLOB
    return with_position(_scan(spark, folder, glob))


def with_position(raw: DataFrame) -> DataFrame:
    return raw.select(
        "*",
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
    )


def normalize(raw: DataFrame, max_tokens: int | None = None, tag: str = " ") -> DataFrame:
    """The ten cleaned columns plus any position columns the input carries.

    Missing fields become null, a bad rating becomes null, and the category
    comes from the file name unless the input already has one.
    """
    have = set(raw.columns)

    def field(name: str):
        return F.col(name) if name in have else F.lit(None)

    category = F.col("category") if "category" in have else category_of_file(file_name(field("source_file")))
    made = {"category": category, "cleaned_text": clean_text(field("text").cast("string"), max_tokens, tag)}
    columns = [
        made.get(f.name, field(f.name)).try_cast(f.dataType).alias(f.name) if f.name != "cleaned_text"
        else made["cleaned_text"].alias(f.name)
        for f in CLEANED_SCHEMA.fields
    ]
    return raw.select(*[c for c in ("row_id", "block_start") if c in have], *columns)


def write_table(df: DataFrame, path: str, overwrite: bool = True, partition_by: str | None = None) -> None:
    """Zstd Parquet; without ``overwrite`` an existing table is an error."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Column-pruned table scan."""
    return spark.read.parquet(path).select(*columns)


def read_texts(spark: SparkSession, path: str, column: str = "cleaned_text") -> DataFrame:
    """``(row_id, text)`` with null read as the empty string."""
    return spark.read.parquet(path).select("row_id", F.coalesce(F.col(column), F.lit("")).alias("text"))


def label_column(df: DataFrame, preferred: str = "category") -> str:
    """The preferred label column, or the rating when it is absent."""
    return preferred if preferred in df.columns else "rating"

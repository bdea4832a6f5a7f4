"""Incremental cleaning and encoding of arriving review files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textrep.functions.text import MIN_LENGTH, first_tokens, long_enough
from textrep.operators import keyindex
from textrep.operators.dedup import first_of_each, key_columns
from textrep.operators.preprocess import drop_counts, evaluated_once
from textrep.schema import CLEANED_SCHEMA, DEDUP_KEYS, RAW_SCHEMA
from textrep.session import cut_lineage
from textrep.sources.reviews import POSITION, normalize

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _lines(spark: SparkSession, folder: str, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def read_review_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of raw records from arriving JSON-lines files."""
    return _lines(spark, folder, files_per_batch).select("*", F.col("_metadata.file_name").alias("source_file"))


def clean_stream(
    raw: DataFrame, min_length: int = MIN_LENGTH, max_tokens: int | None = None,
    event_time: str | None = None, delay: str = "7 days",
) -> DataFrame:
    """Cleaned stream without duplicates.

    State holds a 256-bit digest per key, not the text. It grows with the data
    unless ``event_time`` names an ingestion time column: then a digest is
    forgotten ``delay`` after its last copy, which bounds the state.
    """
    cleaned = normalize(raw)
    if event_time:
        cleaned = cleaned.withColumn(event_time, F.current_timestamp())
    kept = cleaned.filter(long_enough("cleaned_text", min_length))
    lengths = [F.length(c).cast("string") for c in key_columns(kept, DEDUP_KEYS)]
    digest = F.sha2(F.concat_ws("|", *lengths, *key_columns(kept, DEDUP_KEYS)), 256)
    marked = kept.withColumn("_digest", digest).withColumn("cleaned_text", first_tokens("cleaned_text", max_tokens))
    if event_time:
        return marked.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")
    return marked.dropDuplicates(["_digest"]).drop("_digest")


def running_statistics(raw: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Raw and short rows per category so far, for the ``complete`` output mode."""
    cleaned = normalize(raw)
    return cleaned.groupBy("category").agg(
        F.count(F.lit(1)).alias("raw_rows"), F.count_if(~long_enough("cleaned_text", min_length)).alias("dropped_short")
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the table ``path`` at the counts of all that has arrived, and stop."""
    spark = counts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; a restart goes on where it ended."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def load_reviews(
    spark: SparkSession, folder: str, path: str, checkpoint: str, min_length: int = MIN_LENGTH, files_per_batch: int | None = None,
    buckets: int = keyindex.BUCKETS,
) -> StreamingQuery:
    """Append the first copy of every new review to the table ``path`` and stop.

    Of the copies in a batch the first in (file, line) order stays, and none of
    a review that an earlier batch has loaded. The keys of the table are in
    ``<path>.index``, of which a batch reads the filters and the buckets they point to; an
    index that is missing is made from the table. Every
    batch has a folder of its own, which a repeated batch replaces; its raw,
    short, duplicate and kept rows per category are in ``<path>.counts``.
    """

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        placed = batch.withColumn("row_id", F.monotonically_increasing_id())
        cleaned = cut_lineage(evaluated_once(normalize(placed), "cleaned_text"), "arrived")
        kept = cleaned.filter(long_enough("cleaned_text", min_length))
        index = f"{path}.index"
        if number and not keyindex.has_index(session, index):
            loaded = session.read.parquet(path).filter(F.col("batch") < number)
            keyindex.add(loaded.select(keyindex.digest(loaded).alias("digest")), index, -1, buckets)
        new, _ = keyindex.load(first_of_each(kept, list(POSITION)), index, number, buckets=buckets)
        new.select(*CLEANED_SCHEMA.names).write.mode("overwrite").parquet(f"{path}/batch={number}")
        loaded = session.read.parquet(f"{path}/batch={number}")
        drop_counts(cleaned, loaded, min_length).write.mode("overwrite").json(f"{path}.counts/batch={number}")

    arriving = _lines(spark, folder, files_per_batch).select(
        "*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block_start")
    )
    return arriving.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encode_stream(
    spark: SparkSession, table: str, path: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame]
) -> StreamingQuery:
    """Encode the rows added to a cleaned table since the last run.

    ``encode`` maps ``(row_id, cleaned_text, ...)`` rows to vectors row by row;
    the checkpoint takes the place of a stored row offset.
    """
    schema = spark.read.parquet(table).schema
    rows = spark.readStream.schema(schema).parquet(table)
    return write_stream(encode(rows), path, checkpoint)

"""Run times read back from log files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrep.functions.formats import duration_seconds, file_name

# The progress labels each encoder writes, the names of the sources
# of a run time and the line formats.
PROGRESS_LABELS = {
    "tfidf": ["Transform TF-IDF"],
    "w2v": ["Encode pretrained W2V", "Encode W2V", "Encode w2v"],
    "glove": ["Encode GloVe", "Encode glove"],
    "w2v_trained": ["Encode trained W2V", "Training corpus Word2Vec", "Train corpus W2V"],
    "glove_trained": ["Encode trained GloVe", "Training corpus GloVe", "Train GloVe epoch"],
    "sbert": ["Encode sbert"],
    "bge": ["Encode bge"],
}
CLOCK_SOURCE, BAR_SOURCE, TIMER_SOURCE = "/usr/bin/time -v", "tqdm", "internal_perf_counter"
# The clock that ends a wall-clock line, and a bar with nothing left to do: its time and its rate per second or per item.
CLOCK_LINE = r"\(wall clock\).*\s((?:\d+:){1,2}\d+(?:\.\d+)?)\s*$"
FINISHED_BAR = r"\[([\d:]+)<[0:]+,\s*([\d.]+)(s/\w+|\w+/s)[^\]]*\]"


def read_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, modified, line_no, line)``; progress bars rewrite a line with \\r."""
    pieces = spark.read.option("pathGlobFilter", "*.log").text(folder).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"),
        F.posexplode(F.split("value", "\r")).alias("piece", "line"),
    )
    return pieces.select("path", "modified", F.struct("at.b", "at.i", "piece").alias("line_no"), "line")


def wall_clock_text(line: Column) -> Column:
    """Elapsed text of a ``time -v`` line, else null."""
    return F.nullif(F.regexp_extract(line, CLOCK_LINE, 1), F.lit(""))


def bar_rate(line: Column) -> Column:
    """Items per second of a finished bar; slow bars show seconds per item."""
    shown = F.regexp_extract(line, FINISHED_BAR, 2).try_cast("double")
    return F.when(F.regexp_extract(line, FINISHED_BAR, 3).startswith("s/"), F.try_divide(F.lit(1.0), shown)).otherwise(shown)


def progress_labels(encoders: Iterable[str]) -> dict[str, list[str]]:
    """The labels of each encoder; one without a fixed list writes ``Encode <name>``."""
    return {e: PROGRESS_LABELS.get(e, [f"Encode {e}"]) for e in encoders}


def encoder_runtimes(lines: DataFrame, labels: dict[str, list[str]] | None = None) -> DataFrame:
    """``(encoder, elapsed, elapsed_seconds, throughput_per_second, path, source)``.

    A file belongs to an encoder by its name, its command line or a progress
    label. In the newest such file with a result the last wall-clock line wins
    when name or command match, else the last finished progress bar.
    """
    labels = labels or PROGRESS_LABELS
    rules = []
    for encoder, names in labels.items():
        def has(column: Column, names=names) -> Column:
            found = F.lit(False)
            for name in names:
                found = found | column.contains(name)
            return found

        lower = F.lower("line")
        said = F.lit(False)
        for name in names:
            said = said | lower.contains(name.lower())
        named = F.lower(file_name(F.col("path"))).contains(encoder.lower())
        rules.append(
            F.struct(
                F.lit(encoder).alias("encoder"), named.alias("named"),
                lower.contains(f"--encoders {encoder.lower()}").alias("command"), said.alias("said"),
                (has(F.col("line")) & F.col("line").contains("100%") & F.col("line").rlike(FINISHED_BAR)).alias("bar"),
            )
        )
    tagged = lines.select("path", "modified", "line_no", "line", F.explode(F.array(*rules)).alias("t")).select(
        "path", "modified", "line_no", "line", "t.*", wall_clock_text(F.col("line")).alias("clock")
    )
    # Only lines that decide something are aggregated; each file leaves one row per encoder.
    useful = tagged.filter(F.col("named") | F.col("command") | F.col("said") | F.col("clock").isNotNull())
    files = useful.groupBy("encoder", "path").agg(
        F.max("modified").alias("modified"),
        F.max("named").alias("named"), F.max("command").alias("command"), F.max("said").alias("said"),
        F.max_by("clock", F.when(F.col("clock").isNotNull(), F.col("line_no"))).alias("clock"),
        F.max_by("line", F.when(F.col("bar"), F.col("line_no"))).alias("bar_line"),
        F.max("bar").alias("bar"),
    )
    by_clock = F.col("clock").isNotNull() & (F.col("named") | F.col("command"))
    belongs = F.col("named") | F.col("command") | F.col("said")
    results = files.filter(belongs & (by_clock | F.col("bar"))).withColumn("by_clock", by_clock)
    newest = Window.partitionBy("encoder").orderBy(F.col("modified").desc(), F.col("path").desc())
    best = results.withColumn("_r", F.row_number().over(newest)).filter("_r = 1")
    elapsed = F.when(F.col("by_clock"), F.col("clock")).otherwise(F.regexp_extract("bar_line", FINISHED_BAR, 1))
    return best.withColumn("elapsed", elapsed).select(
        "encoder", "elapsed", duration_seconds(F.col("elapsed")).alias("elapsed_seconds"),
        F.when(~F.col("by_clock"), bar_rate(F.col("bar_line"))).alias("throughput_per_second"), "path",
        F.when(F.col("by_clock"), CLOCK_SOURCE).otherwise(BAR_SOURCE).alias("source"),
    )

"""Column expressions for file names, sizes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name layout of the raw exports and the units of a file size.
REVIEW_FILE_GLOB = "amazon_reviews_*_sample_*.jsonl"
ANY_FILE_GLOB = "*.jsonl"
REVIEW_FILE_PATTERN = r"^amazon_reviews_(.+?)_sample_\d+\.jsonl$"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def category_of_file(name: Column) -> Column:
    """Category written in a review file name, else the name without its extension."""
    category = F.regexp_extract(name, REVIEW_FILE_PATTERN, 1)
    return F.when(category != "", category).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def human_bytes(size: Column) -> Column:
    """Size with a 1024-step unit, ties to even; plain bytes keep no decimals."""
    value = size.cast("double")
    text = F.when(value < 1024, F.format_string("%d B", size.cast("long")))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        shown = F.format_string(f"%.2f {unit}", F.bround(value / float(1024**power), 2))
        text = text.otherwise(shown) if unit == SIZE_UNITS[-1] else text.when(value < 1024 ** (power + 1), shown)
    return text


def elapsed_text(seconds: Column) -> Column:
    """``h:mm:ss.ss`` or ``m:ss.ss`` without trailing zeros in the fraction."""
    total = seconds.cast("double")
    hours = F.floor(total / 3600)
    minutes = F.floor((total - hours * 3600) / 60)
    rest = F.format_string("%05.2f", F.bround(total - hours * 3600 - minutes * 60, 2))
    rest = F.regexp_replace(rest, r"\.?0+$", "")
    return F.when(hours > 0, F.format_string("%d:%02d:%s", hours, minutes, rest)).when(
        hours.isNotNull(), F.format_string("%d:%s", minutes, rest)
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of ``h:m:s`` or ``m:s``; anything else is null."""
    parts = F.split(F.trim(text), ":")

    def whole(index: int) -> Column:
        return F.trim(F.get(parts, F.lit(index))).try_cast("int")

    def real(index: int) -> Column:
        return F.trim(F.get(parts, F.lit(index))).try_cast("double")

    seconds = (
        F.when(F.size(parts) == 3, whole(0) * 3600 + whole(1) * 60 + real(2))
        .when(F.size(parts) == 2, whole(0) * 60 + real(1))
    )
    return F.round(seconds, 2)

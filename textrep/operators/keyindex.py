"""Index of the keys of a growing table, so that a batch reads no more of them than it must.

A key is its SHA-256 digest, and the first bytes of the digest name its bucket. Each batch adds
its digests as files by batch and bucket, and a Bloom filter for every bucket.
A later batch asks the filters; only digests that some filter may have are looked
up, and only in the buckets they belong to. Everything is written by batch, so a
repeated batch replaces what it wrote before and sees earlier batches only.

Folders below ``path``: ``keys/batch=/bucket=`` and ``filters/batch=``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.operators.dedup import key_columns
from textrep.schema import DEDUP_KEYS
from textrep.session import cut_lineage

#: Buckets of an index; about one for ten million keys that it will have.
BUCKETS = 64
#: Bits of a filter for each key: one key in 100,000 is looked up in vain.
KEY_BITS = 24
#: Keys of one filter, about; a larger batch has several filters in a bucket.
FILTER_KEYS = 1 << 20

KEYS = "digest binary, batch long, bucket int"
FILTERS = "bucket int, piece int, pieces int, bits binary, batch long"


def digest(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> Column:
    """SHA-256 of the keys and their lengths; a null key is empty."""
    columns = key_columns(df, keys)
    lengths = [F.length(c).cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat_ws("|", *lengths, *columns), 256))


def _number(first: int) -> Column:
    """Four bytes of the digest as a number."""
    return F.conv(F.hex(F.substring("digest", first, 4)), 16, 10).cast("long")


def _words(digests: pa.Array) -> np.ndarray:
    """Digests as rows of four numbers."""
    raw = b"".join(digests.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 4)


def _places(words: np.ndarray, bits: int) -> np.ndarray:
    """Bits of each digest in a filter of ``bits`` bits."""
    step = np.arange(_hashes(), dtype=np.uint64)
    return (words[:, 1:2] + step * (words[:, 2:3] | np.uint64(1))) % np.uint64(bits)


def _hashes() -> int:
    return round(KEY_BITS * math.log(2))


def _filter_of(group: pa.Table) -> pa.Table:
    """Bloom filter of the digests of one bucket (or piece of it)."""
    group = group.combine_chunks()
    words = _words(group.column("digest").combine_chunks())
    flags = np.zeros(-(-len(words) * KEY_BITS // 64) * 64, np.uint8)
    for i in range(0, len(words), 1 << 16):
        flags[_places(words[i : i + (1 << 16)], len(flags)).reshape(-1)] = 1
    first = group.slice(0, 1)
    return pa.table({c: first.column(c) for c in ("bucket", "piece", "pieces")} | {"bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})


def _maybe(digests: pa.Table, filters: pa.Table) -> pa.Table:
    """The digests of one bucket that a filter may have."""
    words = _words(digests.combine_chunks().column("digest").combine_chunks()) if digests.num_rows else np.zeros((0, 4), np.uint64)
    hit = np.zeros(len(words), bool)
    for i in range(filters.num_rows):
        piece, pieces = filters.column("piece")[i].as_py(), filters.column("pieces")[i].as_py()
        bits = np.frombuffer(filters.column("bits")[i].as_py(), np.uint8)
        some = np.flatnonzero(~hit & (_piece(words, pieces) == piece))
        for j in range(0, len(some), 1 << 16):
            rows = some[j : j + (1 << 16)]
            place = _places(words[rows], 8 * len(bits))
            hit[rows] = ((bits[place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
    return digests.filter(pa.array(hit)).select(["digest", "bucket"])


def _piece(words: np.ndarray, pieces: int) -> np.ndarray:
    """Piece of each digest: its bytes 5 to 8, the first of them leading, modulo ``pieces``."""
    number = words[:, 0:1].copy().view(np.uint8).reshape(-1, 8)[:, 4:].astype(np.int64)
    return (number @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) % pieces


def _placed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.select("digest", F.pmod(_number(1), F.lit(buckets)).cast("int").alias("bucket"))


def add(digests: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Write the distinct ``digest`` values of a batch and their filters, in place of what the batch wrote before."""
    rows = _placed(digests, buckets)
    rows.repartition("bucket").sortWithinPartitions("bucket", "digest").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={batch}")
    stored = digests.sparkSession.read.schema("digest binary, bucket int").parquet(f"{path}/keys/batch={batch}")
    pieces = max(1, -(-stored.count() // (FILTER_KEYS * buckets)))
    cut = stored.withColumn("piece", F.pmod(_number(5), F.lit(pieces)).cast("int")).withColumn("pieces", F.lit(pieces))
    made = cut.groupBy("bucket", "piece").applyInArrow(_filter_of, "bucket int, piece int, pieces int, bits binary")
    made.write.mode("overwrite").parquet(f"{path}/filters/batch={batch}")


def _stored(spark: SparkSession, path: str, kind: str, schema: str, before: int) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(f"{path}/{kind}").filter(F.col("batch") < before)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def seen(digests: DataFrame, path: str, before: int, buckets: int = BUCKETS) -> tuple[DataFrame, list[int]]:
    """The ``digest`` values that batches before ``before`` have added, and the buckets that were read to know it.

    ``digests`` are distinct. The filters of the batch's own buckets are read, one eleventh of the keys they
    stand for; keys only of the buckets with a possible hit.
    """
    spark = digests.sparkSession
    filters = _stored(spark, path, "filters", FILTERS, before)
    if filters is None:
        return digests.select("digest").limit(0), []
    rows = cut_lineage(_placed(digests, buckets), "asked-digests")
    asked = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    some = filters.filter(F.col("bucket").isin(asked)).select("bucket", "piece", "pieces", "bits")
    maybe = rows.groupBy("bucket").cogroup(some.groupBy("bucket")).applyInArrow(_maybe, "digest binary, bucket int")
    maybe = cut_lineage(maybe, "possible-digests")
    hit = sorted(r["bucket"] for r in maybe.select("bucket").distinct().collect())
    # Both lists have at most as many entries as there are buckets, and become partition filters.
    keys = _stored(spark, path, "keys", KEYS, before).filter(F.col("bucket").isin(hit))
    return maybe.join(keys.select("digest").distinct(), "digest", "left_semi").select("digest"), hit


def has_index(spark: SparkSession, path: str) -> bool:
    return _stored(spark, path, "filters", FILTERS, 1) is not None


def load(new: DataFrame, path: str, batch: int, keys: Sequence[str] = DEDUP_KEYS, buckets: int = BUCKETS) -> tuple[DataFrame, list[int]]:
    """The rows of ``new`` whose key no earlier batch has, added to the index as ``batch``, and the buckets read.

    ``new`` has one row for each key. An index that is not there yet is started.
    """
    rows = cut_lineage(new.withColumn("digest", digest(new, keys)), "arrived-keys")
    known, read = seen(rows.select("digest"), path, batch, buckets)
    left = cut_lineage(rows.join(known, "digest", "left_anti"), "unseen-rows")
    add(left.select("digest"), path, batch, buckets)
    return left.select(*new.columns), read

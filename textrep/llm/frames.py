"""Frames and Arrow batches shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.words import slices


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def annotate(
    df: DataFrame,
    text: str,
    into: str,
    schema: T.StructType,
    start: Callable[[], Callable[[pa.RecordBatch], pa.Array]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with a struct column ``into``, computed from slices of each batch.

    ``start`` runs once in each task and returns the function of a slice.
    ``keep`` names the columns that return, all by default. Rows stay in their
    partition; nothing is shuffled.
    """
    kept = list(df.columns if keep is None else keep)
    fields = [*(df.schema[c] for c in kept), T.StructField(into, schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, text):
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, work(part)], names=[*kept, into])

    return df.mapInArrow(run, T.StructType(fields))


def ship(df: DataFrame, value) -> Broadcast:
    """``value`` for all tasks, objects of this package included: it travels with its code, as task functions do."""
    return df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(sent: Broadcast):
    """The value of ``ship``, made once in a process."""
    if not hasattr(sent, "made"):
        sent.made = cloudpickle.loads(sent.value)
    return sent.made


def struct_of(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def remainder(key: str | Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; null where the key is null."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % divisor


def digest(parts: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings, joined by commas."""
    return F.sha2(F.array_join(parts, ","), 256)


def sent(df: DataFrame, key_bytes: int, limit: int) -> DataFrame | None:
    """``df`` marked for broadcast if its rows of ``key_bytes`` stay below ``limit`` bytes, else None."""
    most = limit // key_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else None

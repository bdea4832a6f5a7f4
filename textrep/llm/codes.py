"""Short codes of vectors: each part of a vector becomes the number of its codebook's nearest entry.

The distinct parts of all vectors, with their counts, are a trie: sorted by their
components, parts with the same first components are neighbours. A task walks its sorted
parts depth first and keeps, for every component of the path, the distances to all
entries summed so far; a part adds only the components that it does not share with the part before.
The leaves give the nearest entry, the error and the weighted sums of the next codebook.

All numbers are integers and exact: sixty-four bits where they are known to do, Python's own beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textrep.llm.frames import sent
from textrep.session import cut_lineage

#: Units of a component, parts of a vector, entries of a codebook and rounds of training.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Leaves visited with one array operation for each component.
WINDOW = 4096
#: Numbers from here on are multiples of 1/SCALE anyway.
WHOLE = float(1 << 50)
#: Numbers from here on are whole, and may overflow when multiplied.
HUGE = 1e300
MOST_LABEL_BYTES = 32 << 20


class Walk:
    """A depth-first walk over sorted parts; ``path`` holds the distances along the last part."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.last, self.path = entries, None, None

    def leaves(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower) and squared distance of each of the next parts."""
        found = [self._window(parts[i : i + WINDOW]) for i in range(0, len(parts), WINDOW)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _window(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entries, width = self.entries, parts.shape[1]
        most = max(int(abs(parts).max(initial=0)), int(abs(entries).max(initial=0)))
        if 4 * most * most * max(width, 1) >= 1 << 62 or any(level.dtype == object for level in self.path or ()):
            parts, entries = parts.astype(object), entries.astype(object)
        kind = entries.dtype
        new = np.ones(parts.shape, bool)
        new[1:] = parts[1:] != parts[:-1]
        if self.last is not None:
            new[0] = parts[0] != self.last
        new = np.logical_or.accumulate(new, axis=1)
        # Node 0 of a level is the one on the path of the part before this window.
        above, place, path = np.zeros((1, len(entries)), kind), np.zeros(len(parts), np.int64), []
        for level in range(width):
            heads = np.flatnonzero(new[:, level])
            step = parts[heads, level][:, None] - entries[:, level]
            nodes = above[place[heads]] + step * step
            before = self.path[level] if self.path else np.zeros(len(entries), kind)
            above = np.concatenate([np.asarray(before, kind)[None], nodes])
            place = np.cumsum(new[:, level])
            path.append(above[place[-1]])
        self.last, self.path = parts[-1], path
        nearest = above.argmin(axis=1)
        return nearest[place], above[np.arange(len(above)), nearest][place]


def borders(width: int, parts: int) -> list[int]:
    """Borders of the parts of a vector; they are equal if the width allows it."""
    return [i * width // parts for i in range(parts + 1)]


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """A list column of one length with multiples of 1/``scale`` as a matrix of integers."""
    rows = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    if rows.size and np.abs(rows).max() >= float(1 << 62) / scale:
        return np.array([[int(x * scale) if abs(x) < HUGE else int(x) * scale for x in row] for row in rows.tolist()], object).reshape(rows.shape)
    return (rows * scale).astype(np.int64)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of the runs of equal values."""
    ends = [*np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)] if len(values) else []
    yield from zip([0, *ends[:-1]], ends)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def units(vector: str, scale: int) -> Column:
    """Components rounded down to multiples of 1/``scale``."""
    return F.transform(vector, lambda x: F.when(F.abs(x) < WHOLE, F.floor(x * scale).cast("double") / scale).otherwise(x))


def distinct_parts(rows: DataFrame, parts: int) -> DataFrame:
    """``(width, at, part, n)`` of each distinct part at each place, sorted within files; ``rows`` have ``v``."""
    cut = lambda i: F.floor(F.size("v") * i / parts).cast("int")
    listed = F.array(*[F.slice("v", cut(i) + 1, cut(i + 1) - cut(i)) for i in range(parts)])
    each = rows.select(F.size("v").alias("width"), F.posexplode(listed).alias("at", "part"))
    counted = each.groupBy("width", "at", "part").agg(F.count("*").alias("n"))
    return cut_lineage(counted.repartitionByRange("width", "at", "part").sortWithinPartitions("width", "at", "part"), "vector-parts")


def _sums(known: DataFrame, books: dict[int, list[np.ndarray]], scale: int) -> DataFrame:
    """``(width, at, entry, n, sums)``: count and component sums, as decimal text, of the parts nearest to each entry."""
    shared = known.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, walk, at = {}, None, None
        for batch in batches:
            widths, places = batch.column("width").to_numpy(), batch.column("at").to_numpy()
            for low, high in _runs(widths.astype(np.int64) << 8 | places):
                here = (int(widths[low]), int(places[low]))
                if here != at:
                    walk, at = Walk(shared.value[here[0]][here[1]]), here
                for i in range(low, high, WINDOW):
                    size = min(WINDOW, high - i)
                    values, n = integers(batch.column("part").slice(i, size), scale), batch.column("n").slice(i, size).to_numpy()
                    nearest, _ = walk.leaves(values)
                    if int(n.sum()) * int(abs(values).max(initial=0)) >= 1 << 62:
                        values = values.astype(object)
                    for entry in np.unique(nearest).tolist():
                        mine = nearest == entry
                        total = totals.setdefault((*here, entry), [0, [0] * values.shape[1]])
                        total[0] += int(n[mine].sum())
                        total[1] = [a + int(b) for a, b in zip(total[1], (values[mine] * n[mine][:, None]).sum(axis=0))]
        keys = list(totals)
        columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([totals[k][0] for k in keys], pa.int64()), pa.array([list(map(str, totals[k][1])) for k in keys], pa.list_(pa.string()))],
            names=["width", "at", "entry", "n", "sums"],
        )

    def merge(group: pa.Table) -> pa.Table:
        sums = [str(sum(map(int, column))) for column in zip(*group.column("sums").to_pylist())]
        n = sum(group.column("n").to_pylist())
        return group.slice(0, 1).set_column(3, "n", pa.array([n])).set_column(4, "sums", pa.array([sums], pa.list_(pa.string())))

    schema = "width int, at int, entry int, n long, sums array<string>"
    return known.mapInArrow(run, schema).groupBy("width", "at", "entry").applyInArrow(merge, schema)


def _numbers(rows: list[list[int]], width: int) -> np.ndarray:
    most = max((abs(x) for row in rows for x in row), default=0)
    return np.array(rows, object if most >= 1 << 62 else np.int64).reshape(len(rows), width)


def learn(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> dict[int, list[np.ndarray]]:
    """Codebooks by width of the vectors and place of the part; ``rows`` have ``id`` and ``v`` in multiples of 1/``scale``.

    The vectors with the smallest ids start them, null ids last and equal ids by
    their components. Only codebooks and their sums reach the driver.
    """
    place = F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.col("id").asc_nulls_last(), "v"))
    first = rows.select("id", "v").withColumn("place", place).where(F.col("place") <= entries).select("place", "v").toArrow()
    books: dict[int, list[np.ndarray]] = {}
    sizes = np.array([len(v) for v in first.column("v").to_pylist()], np.int64)
    for width in sorted(set(sizes.tolist())):
        some = first.filter(pa.array(sizes == width)).sort_by("place").column("v").combine_chunks()
        whole, cuts = integers(some, scale), borders(width, parts)
        books[width] = [whole[:, low:high] for low, high in zip(cuts, cuts[1:])]
    if not books:
        return books
    known = distinct_parts(rows, parts)
    for _ in range(rounds):
        moved = {width: [book.tolist() for book in listed] for width, listed in books.items()}
        for r in _sums(known, books, scale).collect():
            moved[r["width"]][r["at"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        books = {width: [_numbers(book, books[width][i].shape[1]) for i, book in enumerate(listed)] for width, listed in moved.items()}
    return books


def encode(rows: DataFrame, books: dict[int, list[np.ndarray]], scale: int = SCALE) -> DataFrame:
    """``rows`` (with ``v``) with ``code``, an array of entry numbers, and ``error`` in place of ``v``.

    ``error`` is null beyond the range of a long.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in rows.columns if c != "v"]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("v")
            widths = np.diff(vectors.offsets.to_numpy())
            for low, high in _runs(widths):
                for i in range(low, high, WINDOW):
                    part = batch.slice(i, min(WINDOW, high - i))
                    listed = shared.value[int(widths[low])]
                    values, cuts = integers(part.column("v"), scale), borders(int(widths[low]), len(listed))
                    codes, error = np.zeros((part.num_rows, len(listed)), np.int32), np.zeros(part.num_rows, object)
                    for at, book in enumerate(listed):
                        mine = values[:, cuts[at] : cuts[at + 1]]
                        order = np.lexsort(mine.T[::-1]) if mine.shape[1] else np.arange(len(mine))
                        nearest, far = Walk(book).leaves(mine[order])
                        codes[order, at] = nearest
                        error[order] += far
                    errors = pa.array([e if e < 1 << 63 else None for e in error.tolist()], pa.int64())
                    code = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * codes.shape[1], pa.int32()), pa.array(codes.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), code, errors], names=[*kept, "code", "error"])

    return rows.select(*kept, "v").mapInArrow(run, f"{fields}, code array<int>, error long")


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex SHA-256 of all components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def compress(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """``(key, code, error, label_error, codebooks_sha256)`` of each usable vector.

    Rows whose vector is null, or has a null or a number that is not finite, go.
    Null keys and repeated keys are vectors of their own. Vectors of each
    width have codebooks of their own; a width that the parts do not divide has parts
    that differ by one component, an empty vector has empty parts and no error. With
    fewer vectors than entries a codebook has as many entries as there are vectors. Errors and label errors beyond
    the range of a long are null. ``code`` has two hex digits for each part
    (``entries`` up to 256). Other columns are not read, whatever their names.
    """
    base = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    base = cut_lineage(base.where(usable("v")).withColumn("v", units("v", scale)), "vector-units")
    books = learn(base, entries, parts, rounds, scale)
    names = {width: digest(listed) for width, listed in books.items()}
    name = F.lit(None).cast("string")
    for width, found in names.items():
        name = F.when(F.col("width") == width, F.lit(found)).otherwise(name)
    coded = cut_lineage(encode(base.withColumn("width", F.size("v")), books, scale), "vector-codes")
    whole = F.count("error") == F.count("*")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.when(whole, F.try_sum("error")).alias("label_error"))
    few = None if coded.schema["label"].dataType.simpleString() in ("string", "binary") else sent(totals, 32, MOST_LABEL_BYTES)
    out = coded.join(totals if few is None else few, F.col("label").eqNullSafe(F.col("of")), "left")
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))), "")
    return out.select(F.col("id").alias(key), code.alias("code"), "error", "label_error", name.alias("codebooks_sha256"))

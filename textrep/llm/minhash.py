"""Near-duplicate documents by circulant MinHash with an exact check.

One permutation scatters the shingles, a second one, shifted circularly by 0, 1,
2, ..., gives all coordinates of a signature. Both permute the 32-bit numbers.
Bands of coordinates are buckets, buckets propose pairs, and every pair is
confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.components import components
from textrep.llm.frames import annotate, sent, struct_of
from textrep.llm.words import BLANKS, Words, mix, split_words, window_hashes, window_starts
from textrep.session import cut_lineage

SHINGLE = 5
#: Two sets at the threshold of 0.85 share no band once in 2 million pairs: (1 - 0.85 ** 5) ** 25.
BANDS, ROWS = 25, 5
#: Least similarity in hundredths.
LEAST = 85
#: Ids sent to the tasks that pick candidates; more are joined by a shuffle.
MOST_ID_BYTES = 32 << 20

SKETCH = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]
)
SET = T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))])


def _scatter(x: np.ndarray, key: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= np.uint32(key)
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and the number of shingles before each text.

    A text of fewer words has its whole sequence as its only shingle, an empty one has none.
    """
    hashes, counts = words.hashes(), words.counts
    starts = window_starts(words.first, width)
    made = [window_hashes(hashes, width)[starts]]
    owner = [np.repeat(np.arange(len(counts)), np.maximum(counts - width + 1, 0))]
    for size in range(1, width):
        short = np.flatnonzero(counts == size)
        if len(short):
            whole = hashes[words.first[short][:, None] + np.arange(size)]
            made.append(np.array([window_hashes(row, size)[0] for row in whole], np.uint64))
            owner.append(short)
    shingle, text = np.concatenate(made), np.concatenate(owner)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(shingle), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    shingle, text = shingle[new], text[new]
    return shingle, np.searchsorted(text, np.arange(len(counts) + 1))


def signatures(shingle: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` coordinates for each set; no set may be empty."""
    scattered = _scatter(shingle.astype(np.uint32), 0x2545F491)
    out = np.empty((len(first) - 1, size), np.uint32)
    for shift in range(size):
        out[:, shift] = np.minimum.reduceat(_scatter(scattered + np.uint32(shift), 0x9E3779B9), first[:-1])
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signature.shape[1] // rows
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for row in range(rows):
        key = mix(key * np.uint64(0xA0761D6478BD642F) + parts[:, :, row])
    return key


def _lists(first: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def sketches(words: Words, width: int, bands: int, rows: int) -> pa.StructArray:
    """Size, 128-bit fingerprint and bands of each set; only sets of two or more have bands."""
    shingle, first = shingle_sets(words, width)
    sizes = np.diff(first)
    prints = np.zeros((2, len(sizes)), np.uint64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        for i, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
            prints[i, filled] = np.add.reduceat(mix(shingle ^ np.uint64(salt)), first[filled])
    large = np.flatnonzero(sizes > 1)
    keys = np.zeros((0, bands), np.uint64)
    if len(large):
        inside = np.repeat(sizes > 1, sizes)
        begin = np.concatenate([[0], np.cumsum(sizes[large])])
        keys = band_keys(signatures(shingle[inside], begin, bands * rows), rows)
    return struct_of(
        n=pa.array(sizes, pa.int64()),
        f1=pa.array(prints[0].view(np.int64)),
        f2=pa.array(prints[1].view(np.int64)),
        bands=_lists(np.concatenate([[0], np.cumsum(np.where(sizes > 1, bands, 0))]), keys.reshape(-1)),
    )


def _near(a: str, b: str, least: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * least


def _similar(met: Column, n: str, other: str, least: int) -> Column:
    return met * 100 >= (F.col(n) + F.col(other) - met) * least


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, na, nb, met)``: sizes of both full sets of a pair and of their intersection."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    found = pairs.join(left, "a").join(right, "b")
    return found.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("met"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = SHINGLE,
    least: int = LEAST,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)`` for each row of ``docs``.

    Copies with the same set are one class, named by its smallest key; only
    classes are compared. In each bucket all classes meet the one that shares
    most bucket places; then only classes of other components meet, in buckets
    that hold several. Any pair that shares a bucket is either checked or
    already connected, so no component is lost to a large bucket.

    Null or empty texts have no shingles and are linked with nothing. A row
    without key has no component and is kept. Repeated rows get the same
    result; rows that share a key but not the text are compared by their texts.
    """
    base = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))

    def start():
        return lambda part: sketches(split_words(part.column("text"), BLANKS, lower=True), width, bands, rows)

    sketch = cut_lineage(annotate(base, "text", "s", SKETCH, start, ["id"]).select("id", "s.*"), "sketches")
    classes = sketch.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("id"))
    links = _links(base, sketch, classes, width, least)
    roots = components(links)
    named = classes.join(roots, F.col("id") == F.col("node"), "left").select("f1", "f2", F.coalesce("root", "id").alias("found"))
    component = F.when(F.col("n") > 0, F.coalesce("found", "id")).otherwise(F.col("id"))
    return (
        sketch.join(named, ["f1", "f2"], "left")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def _links(base: DataFrame, sketch: DataFrame, classes: DataFrame, width: int, least: int) -> DataFrame:
    """Confirmed links between classes, enough to connect all that are linked."""
    placed = sketch.where("size(bands) > 0").join(classes, ["f1", "f2", "id"], "left_semi").select("id", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    placed = cut_lineage(placed.join(shared, "bucket"), "buckets")
    sets = cut_lineage(_sets(base, placed.select("id").distinct(), width), "shingle-sets")

    weight = placed.groupBy("id").agg(F.sum("m").alias("weight"))
    hub = placed.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"), "n")).alias("h"))
    hub = cut_lineage(hub.select("bucket", (-F.col("h.minus")).alias("b"), F.col("h.n").alias("nb")), "hubs")
    first = placed.join(hub, "bucket").where(_near("n", "nb", least)).select(F.col("id").alias("a"), "b").where("a <> b").distinct()
    first = cut_lineage(_measured(first, sets), "hub-pairs")
    close = first.where(_similar(F.col("met"), "na", "nb", least)).select("a", "b")

    roots = components(close)
    labelled = placed.join(roots, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("c"))
    labelled = cut_lineage(labelled, "labelled-buckets")
    parts = labelled.groupBy("bucket", "c").agg(F.count("*").alias("size"))
    main = parts.groupBy("bucket").agg(F.max(F.struct("size", "c")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("x.c").alias("main"))
    mixed = cut_lineage(labelled.join(main, "bucket").join(hub.drop("nb"), "bucket"), "mixed-buckets")
    able = mixed.join(_shared_sizes(sets, mixed), "id").where(F.col("k") * 100 >= F.col("n") * least)
    places = able.groupBy("id").agg(F.collect_set("bucket").alias("places"))
    inside = first.select(F.col("a").alias("id"), "b", "met")
    able = able.join(inside, ["id", "b"], "left").withColumn("met", F.when(F.col("id") == F.col("b"), F.col("n")).otherwise(F.col("met")))
    able = cut_lineage(able.join(places, "id"), "open-buckets")
    others = able.where("c <> main").select("bucket", *(F.col(x).alias(f"{x}_2") for x in ("id", "n", "k", "met", "c", "places")))
    by_hub = F.least("met", "met_2") + F.least(F.col("k") - F.col("met"), F.col("k_2") - F.col("met_2"))
    most = F.when(F.col("met").isNotNull() & F.col("met_2").isNotNull(), by_hub).otherwise(F.least("k", "k_2"))
    crossed = able.join(others, "bucket").where(
        (F.col("c") != F.col("c_2"))
        & ((F.col("c") == F.col("main")) | (F.col("id") < F.col("id_2")))
        & _similar(most, "n", "n_2", least)
        & (F.array_min(F.array_intersect("places", "places_2")) == F.col("bucket"))
    )
    second = _measured(crossed.select(F.col("id").alias("a"), F.col("id_2").alias("b")).distinct(), sets)
    return close.union(second.where(_similar(F.col("met"), "na", "nb", least)).select("a", "b"))


def _shared_sizes(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """``(id, k)``: shingles of a set that any other set in these buckets has too, so no intersection is larger."""
    chosen = sets.join(placed.select("id").distinct(), "id", "left_semi")
    alone = chosen.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("m"), F.min("id").alias("id"))
    alone = alone.where("m = 1").groupBy("id").agg(F.count("*").alias("alone"))
    return chosen.join(alone, "id", "left").select("id", (F.size("shingles") - F.coalesce("alone", F.lit(0))).alias("k"))


def _sets(base: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the given rows."""
    few = sent(ids, 8, MOST_ID_BYTES)
    chosen = base.join(ids if few is None else few, "id", "left_semi")

    def start():
        def work(part: pa.RecordBatch) -> pa.Array:
            shingle, first = shingle_sets(split_words(part.column("text"), BLANKS, lower=True), width)
            return struct_of(shingles=_lists(first, shingle))

        return work

    return annotate(chosen, "text", "s", SET, start, ["id"]).select("id", "s.shingles")

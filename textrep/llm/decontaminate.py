"""Benchmark decontamination: Wu-Manber search for many word windows at once.

The symbols of the search are words. A shift table over blocks of two words says
how far the search may jump, buckets of the patterns by their last block propose
patterns, the first word thins them and a comparison of all words confirms. All
documents of a slice are searched side by side: each step moves one cursor per
stretch of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.frames import annotate, digest, free_name, ship, shipped, struct_of
from textrep.llm.words import NOT_ALNUM, Words, split_words, window_starts
from textrep.session import cut_lineage

WINDOW = 10
#: Benchmark text searched at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 16 << 20
#: Windows that one cursor searches.
STRETCH = 256

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Patterns:
    """Distinct windows of one length with the tables of the search."""

    width: int
    words: np.ndarray  # windows x width, hashes
    known: np.ndarray  # sorted hashes of all words in the windows
    shift: np.ndarray  # by block
    bucket: np.ndarray  # sorted blocks at the end of the windows
    member: np.ndarray  # windows in the order of ``bucket``
    item_list: np.ndarray  # list of items of each window; windows with the same items share one
    first_item: np.ndarray  # items of list i: items[first_item[i] : first_item[i + 1]]
    items: np.ndarray

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Place in ``known``, -1 for words of no window."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at, -1)

    def block(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return before * np.int64(len(self.known)) + last

    def slot(self, block: np.ndarray) -> np.ndarray:
        spread = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(40)).astype(np.int64) & (len(self.shift) - 1)


def _item_lists(first: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(list of each window, first item of each list, items of the lists)``, equal lists once."""
    sizes = np.diff(first)
    alone, of = np.unique(items[first[:-1]][sizes == 1], return_inverse=True)
    lists, known = np.empty(len(sizes), np.int64), {}
    lists[sizes == 1] = of.reshape(-1)
    for i in np.flatnonzero(sizes > 1):
        lists[i] = len(alone) + known.setdefault(items[first[i] : first[i + 1]].tobytes(), len(known))
    held = [alone, *(np.frombuffer(k, items.dtype) for k in known)]
    lengths = np.concatenate([np.ones(len(alone), np.int64), np.array([len(x) for x in held[1:]], np.int64)])
    return lists, np.concatenate([[0], np.cumsum(lengths)]), np.concatenate(held)


def patterns(words: np.ndarray, item: np.ndarray) -> Patterns:
    """Tables for windows (rows of word hashes), each of the item beside it."""
    width = words.shape[1]
    distinct, place = np.unique(words, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([place.reshape(-1), item], axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    made = Patterns(width, distinct, np.unique(distinct), np.zeros(1, np.int64), None, None, *_item_lists(first, pairs[:, 1]))
    size = 1 << int(np.clip(np.ceil(np.log2(8 * distinct.size + 2)), 10, 24))
    span = min(2, width)
    made.shift = np.full(size, width - span + 1, np.int64)
    codes = np.searchsorted(made.known, distinct)
    for end in range(span - 1, width):
        before = codes[:, end - 1] if span == 2 else np.zeros(len(codes), np.int64)
        block = made.block(before, codes[:, end])
        np.minimum.at(made.shift, made.slot(block), width - 1 - end)
        if end == width - 1:
            made.member = np.argsort(block, kind="stable")
            made.bucket = block[made.member]
    return made


def benchmark_patterns(texts: pa.Array, item: np.ndarray, window: int = WINDOW) -> list[Patterns]:
    """One set of tables for each length of window; a short item is one window."""
    words = split_words(texts, NOT_ALNUM, lower=True)
    hashes, counts = words.hashes(), words.counts
    out = []
    for width in sorted({min(int(n), window) for n in counts if n}):
        chosen = counts >= window if width == window else counts == width
        first = np.concatenate([[0], np.cumsum(np.where(chosen, counts, 0))])
        inside = np.repeat(chosen, counts)
        starts = window_starts(first, width)
        owner = np.repeat(item, np.maximum(np.diff(first) - width + 1, 0))
        out.append(patterns(hashes[inside][starts[:, None] + np.arange(width)], owner))
    return out


def occurrences(hashes: np.ndarray, first: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """``(start word, window)`` of every occurrence within one text."""
    ends = first[1:] - p.width + 1  # one past the last start
    counts = np.maximum(-(-(ends - first[:-1]) // STRETCH), 0)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(first[:-1], counts) + within * STRETCH
    stop = np.minimum(at + STRETCH, np.repeat(ends, counts))
    reach = p.width - 1
    starts, blocks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        last = p.code(hashes[at + reach])
        before = p.code(hashes[at + reach - 1]) if p.width > 1 else np.zeros(len(at), np.int64)
        block = p.block(before, last)
        jump = np.where(last < 0, p.width, np.where(before < 0, max(p.width - 1, 1), p.shift[p.slot(block)]))
        ready = jump == 0
        starts.append(at[ready])
        blocks.append(block[ready])
        at = at + np.maximum(jump, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    start, block = np.concatenate(starts), np.concatenate(blocks)
    low, high = np.searchsorted(p.bucket, block, "left"), np.searchsorted(p.bucket, block, "right")
    sizes = high - low
    place = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start, window = np.repeat(start, sizes), p.member[place]
    same = hashes[start] == p.words[window, 0]
    start, window = start[same], window[same]
    same = (hashes[start[:, None] + np.arange(p.width)] == p.words[window]).all(axis=1)
    return start[same], window[same]


def _lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)


def search(words: Words, tables: list[Patterns], names: np.ndarray) -> pa.StructArray:
    """For each text the number of words, the merged spans of its hits and the items found."""
    hashes = words.hashes()
    texts = len(words.first) - 1
    edge = np.zeros(len(hashes) + 1, np.int64)
    found = [np.zeros((0, 2), np.int64)]
    for p in tables:
        start, window = occurrences(hashes, words.first, p)
        np.add.at(edge, start, 1)
        np.subtract.at(edge, start + p.width, 1)
        text = np.searchsorted(words.first, start, "right") - 1
        text, lists = np.unique(np.stack([text, p.item_list[window]], axis=1), axis=0).T
        sizes = p.first_item[lists + 1] - p.first_item[lists]
        place = np.repeat(p.first_item[lists], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        found.append(np.unique(np.stack([np.repeat(text, sizes), p.items[place]], axis=1), axis=0))
    hit = np.cumsum(edge)[:-1] > 0
    opens, closes = hit.copy(), hit.copy()
    if len(hit):
        opens[1:] &= ~hit[:-1]
        closes[:-1] &= ~hit[1:]
        heads = words.first[:-1][words.counts > 0]
        tails = words.first[1:][words.counts > 0] - 1
        opens[heads], closes[tails] = hit[heads], hit[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    origin = words.first[np.searchsorted(words.first, starts, "right") - 1]
    spans = struct_of(start=pa.array(starts - origin, pa.int64()), end=pa.array(ends - origin, pa.int64()))
    pairs = np.unique(np.concatenate(found), axis=0)
    return struct_of(
        n_words=pa.array(words.counts, pa.int64()),
        spans=_lists(np.searchsorted(starts, words.first), spans),
        items=_lists(np.searchsorted(pairs[:, 0], np.arange(texts + 1)), pa.array(names[pairs[:, 1]], pa.string())),
    )


def _scan(df: DataFrame, text: str, into: str, items: pa.Table, window: int, keep: list[str]) -> DataFrame:
    names = np.array(sorted(set(items.column(0).to_pylist())), dtype=object)
    rank = {name: i for i, name in enumerate(names)}
    item = np.array([rank[name] for name in items.column(0).to_pylist()], np.int64)
    texts = items.column(1).combine_chunks() if items.num_rows else pa.array([], pa.string())
    tables = ship(df, (benchmark_patterns(texts, item, window), names))

    def start():
        found, named = shipped(tables)
        return lambda part: search(split_words(part.column(text), NOT_ALNUM, lower=True), found, named)

    return annotate(df, text, into, FOUND, start, keep)


def find_benchmark(
    df: DataFrame,
    benchmark: DataFrame,
    into: str,
    text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``df`` with a struct ``into``: ``n_words``, ``spans`` of hit words (from 0, end not included) and ``items``.

    ``benchmark`` has ``item_id`` and ``text``; an item without id has the id
    ``''``, repeated ids are one item. Null texts have no words. The benchmark
    is sent to the tasks in blocks of at most about ``block_bytes`` of text
    (whole items); above one block the documents are scanned once for each.
    """
    if keep is None:
        keep = df.columns
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    blocks = int(-(-size // block_bytes)) or 1
    if blocks == 1:
        return _scan(df, text, into, items.toArrow(), window, keep)
    parts = []
    out = df
    for block in range(blocks):
        chosen = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        parts.append(free_name(out, f"_block{block}"))
        out = cut_lineage(_scan(out, text, parts[-1], chosen, window, out.columns), "benchmark-hits")
    spans = F.array_sort(F.flatten(F.array(*(F.col(p)["spans"] for p in parts))))
    merged = F.struct(
        F.col(parts[0])["n_words"].alias("n_words"),
        F.aggregate(
            spans,
            F.slice(spans, 1, 0),
            lambda done, s: F.when(
                (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]),
                F.concat(
                    F.slice(done, 1, F.size(done) - 1),
                    F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
                ),
            ).otherwise(F.concat(done, F.array(s))),
        ).alias("spans"),
        F.array_sort(F.flatten(F.array(*(F.col(p)["items"] for p in parts)))).alias("items"),
    )
    return out.select(*keep, merged.alias(into))


def hit_columns(found: str) -> list:
    """The figures of one document from the struct of ``find_benchmark``."""
    hits = F.aggregate(F.col(found)["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return [
        F.col(found)["n_words"].alias("n_words"),
        hits.alias("n_hit"),
        F.size(F.col(found)["items"]).cast("long").alias("n_items"),
        digest(F.col(found)["items"]).alias("items_sha256"),
        (F.size(F.col(found)["spans"]) > 0).alias("contaminated"),
    ]

"""Token ids of whole documents in binary files, and the documents read from them again.

Ids are renamed by frequency, so that the most frequent ones take one byte. A
block of documents has its ranks as bytes without leading zeros, and apart from
them control bytes with the number of bytes (two bits) of four ranks each. A table
gives the four sizes of a control byte; their running sums are the places of the
ranks, so a block is decoded with a few array look-ups.

Files of ``write_tokens`` below ``path``, Parquet as the container so that any store
Spark writes to will do and a lost task leaves nothing behind:

- ``ranks``: ``(rank, id, count)`` of every id that occurs.
- ``blocks``: ``(part, block, first, n, keys, lengths, control, data)``, consecutive documents
  in order of part and block. ``first`` counts the ids of the part before the block, ``n``
  those in it, ``lengths`` those of each document.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections.abc import Callable, Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textrep.llm.words import LOWER, slices, text_bounds
from textrep.session import cut_lineage

#: Id that ends a document.
END = 2
#: Ids of a block; a block ends with the document that reaches them, so a long document is a block of its own.
BLOCK_IDS = 1 << 14
#: Bytes of text cut into words at once.
TEXT_BYTES = 8 << 20
#: Pieces of words whose ids are kept, and characters of a piece that is kept.
KNOWN_PIECES, KNOWN_LENGTH = 1 << 19, 64

#: Bytes of the four ranks of a control byte.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """``(control, data)`` of some ranks below 2^32; the last group is filled with zeros."""
    values = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    values[: len(ranks)] = ranks
    sizes = np.ones(len(values), np.uint8)
    most = next(k for k in (1, 2, 3, 4) if k == 4 or values.max(initial=0) < 1 << (8 * k))
    for k in range(1, most):
        sizes += values >= 1 << (8 * k)
    control = sizes.reshape(-1, 4) - 1
    control = control[:, 0] | control[:, 1] << 2 | control[:, 2] << 4 | control[:, 3] << 6
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[:, :most][np.arange(most) < sizes[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ranks of ``pack``."""
    sizes = SIZES[control].reshape(-1)
    ends = np.cumsum(sizes, dtype=np.int64)
    if len(control) != -(-n // 4) or (ends[-1] if len(ends) else 0) != len(data):
        raise ValueError(f"{n} ids have {len(control)} control bytes and {len(data)} bytes")
    ends, sizes = ends[:n], sizes[:n]
    starts = ends - sizes
    values = data[starts].astype(np.uint32)
    for k in range(1, int(sizes.max(initial=0))):
        some = np.flatnonzero(sizes > k)
        values[some] |= data[starts[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


#: The steps of a tokenizer whose ids are those of its words' letters, digits and signs.
WORD_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BLANK, LETTER, DIGIT, SIGN = range(4)
#: Kinds of the ASCII bytes, and by the second byte those of the characters U+0080 to U+00BF and U+00C0 to U+00FF.
_KIND = np.full((3, 256), SIGN, np.uint8)
_KIND[0, [0x20, *range(0x09, 0x0E)]] = BLANK
_KIND[0, 0x61:0x7B] = _KIND[2, 0x80:0xC0] = LETTER
_KIND[0, 0x30:0x3A] = DIGIT
_KIND[1, [0x85, 0xA0]] = BLANK
_KIND[1, [0xAA, 0xB5, 0xBA]] = LETTER
_KIND[1, [0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
_KIND[2, [0x97, 0xB7]] = SIGN


def by_words(model: dict) -> bool:
    """Whether a tokenizer lowers its texts and cuts them by ``WORD_PATTERN``, which drops blanks."""
    steps = [[s["type"] for s in (model.get(kind) or {}).get(parts, [])] for kind, parts in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    return steps == list(WORD_STEPS) and model["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN} and model["model"]["type"] == "BPE"


def _byte_signs() -> dict[int, str]:
    """Signs that the byte-level step writes for the UTF-8 bytes of the characters up to U+00FF."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    sign = {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The lowered pieces that ``WORD_PATTERN`` finds in texts of characters up to U+00FF without apostrophes.

    Returned with the number of pieces before each text.
    """
    data = LOWER[data]
    pair = np.flatnonzero((data & 0xFE) == 0xC2)
    capital = pair[(data[pair] == 0xC3) & (data[pair + 1] <= 0x9E) & (data[pair + 1] != 0x97)]
    data[capital + 1] += 0x20
    kind = _KIND[0][data]
    kind[pair] = kind[pair + 1] = _KIND[data[pair] - 0xC1, data[pair + 1]]
    opens = kind != BLANK
    kept = data[opens]
    place = np.cumsum(opens, dtype=np.int32) - opens
    opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    heads = bounds[:-1][bounds[1:] > bounds[:-1]]
    opens[heads] = kind[heads] != BLANK
    opens[pair + 1] = False
    starts = np.flatnonzero(opens)
    offsets = np.append(place[starts], len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(kept))
    return found.dictionary_encode(), np.searchsorted(starts, bounds)


def encoder(model: str, end: int = END) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Function from texts to all their ids and the number of ids of each text, its end included.

    ``model`` is the tokenizer's JSON text. If it cuts texts by ``WORD_PATTERN``,
    each distinct piece of the texts without apostrophes, special tokens and
    characters above U+00FF is encoded once, and its ids are kept; all others are encoded as whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(model)
    cut, special = by_words(json.loads(model)), [t.content.encode() for t in coder.get_added_tokens_decoder().values()]
    # The process of a task takes other tasks after it, and they find the pieces of this one.
    kept = sys.modules.setdefault("textrep_kept", ModuleType("textrep_kept")).__dict__
    kept = kept.setdefault(hashlib.sha256(f"{end} {model}".encode()).hexdigest(), {})
    signs, tokenize = _byte_signs(), coder.model.tokenize

    def whole(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in coder.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        counts = np.fromiter((len(f) + 1 for f in found), np.int64, len(found))
        return np.fromiter((i for f in found for i in (*f, end)), np.uint32, int(counts.sum())), counts

    def by_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coded, first = pieces(data, bounds)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not kept or max(len(kept["place"]), len(kept["ids"]) >> 3) > KNOWN_PIECES:
            kept.update(place={}, ids=np.array([end], np.uint32), ends=np.ones(1, np.int64))
        known = kept["place"]
        fresh = [p for p in distinct if p not in known]
        if fresh:
            found = [[t.id for t in tokenize(p)] for p in "\n".join(fresh).translate(signs | {10: "\n"}).split("\n")]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            known.update(zip(fresh, range(len(kept["ends"]), len(kept["ends"]) + len(fresh))))
            kept["ids"] = np.append(kept["ids"], np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))
            kept["ends"] = np.append(kept["ends"], kept["ends"][-1] + np.cumsum(sizes))
        ids, ends = kept["ids"], kept["ends"]
        number = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        # The end has number 0.
        number = np.append(number, 0)
        sizes = np.diff(ends, prepend=0)[number].astype(np.int32)
        starts = (ends[number] - sizes).astype(np.int32)
        for piece in fresh:
            if len(piece) > KNOWN_LENGTH:
                del known[piece]
        # One place more for each text, where its end goes.
        last = first[1:] + np.arange(len(first) - 1)
        place = np.full(len(coded) + len(last), len(distinct), np.int32)
        inner = np.ones(len(place), bool)
        inner[last] = False
        place[inner] = coded.indices.to_numpy()
        lengths = sizes[place]
        ends = np.cumsum(lengths, dtype=np.int32)
        source = np.repeat(starts[place] - (ends - lengths), lengths)
        source += np.arange(len(source), dtype=np.int32)
        return ids[source], np.diff(ends[last], prepend=0)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        data, bounds = text_bounds(texts)
        if not cut or not len(texts):
            return whole(texts)
        odd = np.flatnonzero((data > 0xC3) | (data == 0x27))
        raw = data.tobytes()
        odd = np.concatenate([odd, *(np.array([m.start() for m in re.finditer(re.escape(s), raw)], np.int64) for s in special)])
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(bounds, odd, "right") - 1] = False
        if plain.all():
            return by_pieces(data, bounds)
        easy = texts.filter(pa.array(plain))
        parts = [by_pieces(*text_bounds(easy)), whole(texts.filter(pa.array(~plain)))]
        counts = np.zeros(len(texts), np.int64)
        counts[plain], counts[~plain] = parts[0][1], parts[1][1]
        mine = np.repeat(plain, counts)
        ids = np.empty(len(mine), np.uint32)
        ids[mine], ids[~mine] = parts[0][0], parts[1][0]
        return ids, counts

    return run


def binary_bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls and the borders of its values."""
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(places, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive runs of some numbers as binary values."""
    width = values.dtype.itemsize
    bounds = np.concatenate([[0], np.cumsum(counts)]) * width
    data = pa.py_buffer(np.ascontiguousarray(values))
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds.astype(np.int64)), data]).cast(pa.binary())


def id_type(model: str, end: int = END) -> str:
    """The narrowest number type for all ids of a tokenizer."""
    from tokenizers import Tokenizer

    return "<u2" if max(*Tokenizer.from_str(model).get_vocab().values(), end) < 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """``(key, tie, ids)`` of each row: ids as little-endian numbers of ``id_type``, the text's hash as ``tie``."""
    sent, dtype = docs.sparkSession.sparkContext.broadcast(model), id_type(model, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, end)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids, counts = encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("tie"), binaries(ids.astype(dtype), counts)], names=["key", "tie", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, tie long, ids binary")


def id_counts(encoded: DataFrame, dtype: str) -> DataFrame:
    """``(id, count)``: every task sums its own ids first; there are at most as many rows as the tokenizer has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                raw = b"".join(batch.column(0).slice(i, 256).to_pylist())
                part = np.bincount(np.frombuffer(raw, dtype), minlength=len(sums))
                part[: len(sums)] += sums
                sums = part
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found])], names=["id", "count"])

    return encoded.select("ids").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_tokens(
    docs: DataFrame, path: str, model: str, key: str = "doc_id", text: str = "text", end: int = END, block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of all documents in ascending order of ``key`` to the files below ``path``.

    A null text is empty and has the end alone. Null keys come first; rows
    with the same key follow the hash of their text, and equal rows stand side by
    side. Other columns are not read. An empty table leaves files without
    rows. A long text is one block: a task holds the text, its ids (four bytes each)
    and its words at once, which is about fifteen times its bytes.
    """
    spark, dtype = docs.sparkSession, id_type(model, end)
    encoded = cut_lineage(encode_documents(docs, model, key, text, end), "token-ids", compression="zstd")
    ranks = sorted(((r["id"], r["count"]) for r in id_counts(encoded, dtype).collect()), key=lambda r: (-r[1], r[0]))
    table = pa.table({"rank": pa.array(range(len(ranks)), pa.int32()), "id": pa.array([r[0] for r in ranks], pa.int32()), "count": pa.array([r[1] for r in ranks], pa.int64())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((r[0] for r in ranks), default=0) + 1, np.uint32)
    rank[[r[0] for r in ranks]] = np.arange(len(ranks))
    sent = spark.sparkContext.broadcast(rank)
    kind = encoded.schema["key"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, width = sent.value, np.dtype(dtype).itemsize
        block = first = size = 0
        keys, ids, lengths, part = [], [], [], None

        def finished() -> pa.RecordBatch:
            nonlocal block, first, size, keys, ids, lengths
            control, data = pack(rank[np.concatenate(ids)])
            names, sizes = pa.concat_arrays(keys), pa.array(np.concatenate(lengths))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (names, sizes)]
            out = pa.RecordBatch.from_arrays(
                [part, pa.array([block]), pa.array([first]), pa.array([size]), *lists, pa.array([control]), pa.array([data])],
                names=["part", "block", "first", "n", "keys", "lengths", "control", "data"],
            )
            block, first, size, keys, ids, lengths = block + 1, first + size, 0, [], [], []
            return out

        for batch in batches:
            raw, bounds = binary_bounds(batch.column("ids"))
            values, bounds = raw.view(dtype), bounds // width
            at = 0
            while at < batch.num_rows:
                to = min(int(np.searchsorted(bounds, bounds[at] + block_ids - size)), batch.num_rows)
                part = batch.column("part").slice(at, 1)
                keys.append(batch.column("key").slice(at, to - at))
                # A copy, so that the batch can go.
                ids.append(values[bounds[at] : bounds[to]].copy())
                lengths.append(np.diff(bounds[at : to + 1]))
                size += int(bounds[to] - bounds[at])
                if size >= block_ids:
                    yield finished()
                at = to
        if size:
            yield finished()

    # The last key spreads equal rows over several parts; which of them comes first makes no difference.
    order = [F.col("key").asc_nulls_first(), F.col("tie"), F.col("row")]
    rows = encoded.withColumn("row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "ids", F.spark_partition_id().alias("part"))
    made = dealt.mapInArrow(blocks, f"part int, block long, first long, n long, keys array<{kind}>, lengths array<long>, control binary, data binary")
    made.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids)`` of each document in the files below ``path``.

    ``start`` is the number of ids of all documents before it; ``ids`` are
    little-endian numbers of four bytes. Blocks are decoded on their own, so
    files and their parts can be read in any order and by any number of tasks.
    """
    ranks = spark.read.parquet(f"{path}/ranks").toArrow()
    names = np.zeros(ranks.num_rows, "<u4")
    names[ranks.column("rank").to_numpy()] = ranks.column("id").to_numpy()
    sent = spark.sparkContext.broadcast(names)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    # One row for each part, which is one task's file.
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = batch.column("lengths")[i].values.to_numpy()
                control, data = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint8) for c in ("control", "data"))
                ids = names[unpack(control, data, batch.column("n")[i].as_py())]
                starts = batch.column("first")[i].as_py() + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(starts), pa.array(lengths), binaries(ids, lengths)], names=["key", "start", "n", "ids"])

    placed = blocks.join(F.broadcast(parts), "part").select("keys", "lengths", "n", (F.col("first") + F.col("before")).alias("first"), "control", "data")
    found = placed.mapInArrow(run, f"key {kind}, start long, n long, ids binary")
    return found.select(F.col("key").alias(key), "start", F.col("n").alias("n_tokens"), "ids")

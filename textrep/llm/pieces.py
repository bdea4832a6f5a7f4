"""Sampled segmentation into pieces by forward filtering and backward sampling.

No piece holds a blank after another character, so the lattice of a text falls
apart into stretches of blanks and the word behind them. Forward sums are made
once for each distinct stretch of a slice; every occurrence then draws its own
path backwards, with numbers that depend on the row's key and the place only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.frames import annotate, ship, shipped
from textrep.llm.words import Words, mix, slices, text_bounds

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The model holds merge ranks, not probabilities: the piece of rank r weighs 1 / (r + 2) ** SHARPNESS.
SHARPNESS = 2.0
#: Weight of a byte that is no piece itself, as a logarithm: it is taken only where nothing else fits.
BYTE = -200.0
SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass
class Vocabulary:
    """Pieces as bytes with a blank for U+2581, their weights, and a table from hashes to ids."""

    pieces: list[bytes]
    weight: np.ndarray
    byte_id: np.ndarray
    longest: int
    known: np.ndarray  # sorted hashes
    ids: np.ndarray

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the hashed strings, -1 for those that are no piece."""
        at = self.slot[(hashes >> np.uint64(44)).astype(np.int64)]
        ok = self.known[at] == hashes
        late = np.flatnonzero(~ok & self.crowded[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(late):
            at[late] = np.minimum(np.searchsorted(self.known, hashes[late]), len(self.known) - 1)
            ok[late] = self.known[at[late]] == hashes[late]
        return np.where(ok, self.ids[at], -1)

    def __post_init__(self) -> None:
        # The first 20 bits lead to a hash; where several hashes share them, the sorted list decides.
        lead = (self.known >> np.uint64(44)).astype(np.int64)
        self.slot = np.zeros(1 << 20, np.int32)
        self.slot[lead] = np.arange(len(lead))
        self.crowded = np.bincount(lead, minlength=1 << 20) > 1


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))[:-1], out=sums[1:])
    return sums


def load(path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [b""] * model.vocab_size()
    byte_id = np.full(256, -1, np.int64)
    for i in range(model.vocab_size()):
        if model.is_byte(i):
            byte_id[int(model.id_to_piece(i)[3:5], 16)] = i
            pieces[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[i] = model.id_to_piece(i).replace("▁", " ").encode()
    if (byte_id < 0).any():
        raise ValueError("the model has no pieces for single bytes")
    whole = [i for i in range(len(pieces)) if pieces[i] and not model.is_byte(i)]
    rank = np.zeros(len(pieces))
    rank[sorted(whole, key=lambda i: (-model.get_score(i), i))] = np.arange(len(whole))
    inverse = _powers(_INVERSE, 1)[0]
    hashes = np.array([prefix_sums(np.frombuffer(pieces[i], np.uint8))[-1] * inverse for i in whole], np.uint64)
    order = np.argsort(hashes)
    weight = -sharpness * np.log(rank + 2)
    return Vocabulary(pieces, weight, byte_id, max(len(pieces[i]) for i in whole), hashes[order], np.array(whole)[order])


def stretches(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Runs of blanks with the word behind them, as byte ranges of each text."""
    opens = np.zeros(len(data) + 1, bool)
    opens[1:-1] = (data[1:] == 0x20) & (data[:-1] != 0x20)
    opens[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    starts = np.flatnonzero(opens[: len(data)])
    return Words(data, starts, np.append(starts[1:], len(data))[: len(starts)], np.searchsorted(starts, bounds))


@dataclass
class Lattice:
    """The pieces that end at each place, by length from 1 to the place's width, one place after another.

    ``share`` sums the path weights over the lengths, relative to the heaviest.
    """

    begin: np.ndarray
    width: np.ndarray
    share: np.ndarray
    piece: np.ndarray

    def draw(self, at: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(piece, length)`` of a drawn piece that ends at each place."""
        cell = self.begin[at]
        border = chance * self.share[cell + self.width[at] - 1]
        on = np.flatnonzero(self.share[cell] <= border)
        while len(on):
            cell[on] += 1
            on = on[self.share[cell[on]] <= border[on]]
        return self.piece[cell], cell - self.begin[at] + 1


def forward(data: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> Lattice:
    """The lattice of stretches; places are laid out by their offset, so that one step of all stretches is one block."""
    sums, inverse = prefix_sums(data), _powers(_INVERSE, len(data))
    sizes = np.diff(first)
    longest = int(min(vocabulary.longest, sizes.max(initial=1)))
    offset = np.arange(len(data)) - np.repeat(first[:-1], sizes) + 1
    order = np.argsort(offset, kind="stable")
    width = np.minimum(offset, longest)
    stops = np.cumsum(width[order])
    begin = np.empty(len(data), np.int64)
    begin[order] = stops - width[order]
    piece = np.full(stops[-1] if len(stops) else 0, -1, np.int32)
    end = np.arange(len(data))
    for length in range(1, longest + 1):
        end = end[offset[end] >= length]
        start = end + 1 - length
        piece[begin[end] + length - 1] = vocabulary.find((sums[end + 1] - sums[start]) * inverse[start])
    share = np.append(vocabulary.weight, -np.inf)[piece]  # -1 is no piece
    alone = np.flatnonzero(piece[begin] < 0)
    share[begin[alone]] = BYTE
    piece[begin[alone]] = vocabulary.byte_id[data[alone]]
    total = np.zeros(len(data))
    steps = np.searchsorted(offset[order], np.arange(1, sizes.max(initial=0) + 2))
    for step in range(1, len(steps)):
        at, wide = order[steps[step - 1] : steps[step]], min(step, longest)
        path = share[begin[at[0]] :][: len(at) * wide].reshape(-1, wide)
        before = total[np.maximum(at[:, None] - np.arange(1, wide + 1), 0)]
        if step <= longest:
            before[:, -1] = 0.0
        path += before
        top = path.max(axis=1)
        path -= top[:, None]
        np.cumsum(np.exp(path, out=path), axis=1, out=path)
        total[at] = top + np.log(path[:, -1])
    return Lattice(begin, width, share, piece)


def sample(texts: pa.Array, keys: np.ndarray, vocabulary: Vocabulary) -> pa.ListArray:
    """Piece ids of each text; ``keys`` are 64-bit numbers that fix the draws of each row."""
    data, bounds = text_bounds(texts)
    cut = stretches(data, bounds)
    _, index, which = np.unique(cut.hashes(), return_index=True, return_inverse=True)
    which = which.reshape(-1)
    sizes = (cut.ends - cut.starts)[index]
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.repeat(cut.starts[index] - first[:-1], sizes) + np.arange(first[-1])
    lattice = forward(data[place], first, vocabulary)
    number = np.arange(len(which)) - np.repeat(cut.first[:-1], cut.counts)
    seed = mix(np.repeat(keys, cut.counts) + mix(number.astype(np.uint64)))
    live = np.arange(len(which))
    at, origin = first[which + 1] - 1, first[which]
    taken, owners, steps = [], [], np.zeros(len(which), np.int64)
    while len(live):
        draw = (mix(seed[live] + steps[live].astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        ids, length = lattice.draw(at, draw)
        taken.append(ids)
        owners.append(live)
        steps[live] += 1
        at = at - length
        on = at >= origin
        live, at, origin = live[on], at[on], origin[on]
    begin = np.concatenate([[0], np.cumsum(steps)])
    out = np.zeros(begin[-1], np.int32)
    for step, (ids, owner) in enumerate(zip(taken, owners)):
        out[begin[owner + 1] - 1 - step] = ids
    return pa.ListArray.from_arrays(pa.array(begin[cut.first], pa.int32()), pa.array(out))


def encode(
    df: DataFrame, into: str, text: str = "text", key: str = "doc_id", model: str = MODEL, seed: int = 0, sharpness: float = SHARPNESS, keep: list[str] | None = None
) -> DataFrame:
    """``df`` with a struct ``into`` of ``ids``, a segmentation drawn for each row.

    The draw depends on the key (null counts as a key of its own), the seed and
    the text, not on the partition, so rows with equal keys and texts get equal
    pieces. A null or empty text has no pieces.
    """
    sent = ship(df, load(model, sharpness))

    def start():
        vocabulary = shipped(sent)

        def work(part: pa.RecordBatch) -> pa.Array:
            found = []
            for small in slices(part, text, SLICE):
                names = [hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest() for k in small.column(key).to_pylist()]
                found.append(sample(small.column(text), np.frombuffer(b"".join(names), np.uint64), vocabulary))
            return pa.StructArray.from_arrays([pa.concat_arrays(found)], names=["ids"])

        return work

    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return annotate(df, text, into, schema, start, keep)


def decode(df: DataFrame, ids: str, into: str, model: str = MODEL) -> DataFrame:
    """``df`` with the text of the piece ids; null ids give null, none give an empty text."""
    sent = ship(df, load(model).pieces)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def run(batches):
        sizes = np.array([len(p) for p in shipped(sent)], np.int64)
        places = np.cumsum(sizes) - sizes
        table = np.frombuffer(b"".join(shipped(sent)), np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                found = lists.flatten().to_numpy()
                size = sizes[found]
                ends = np.concatenate([[0], np.cumsum(size)])
                raw = table[np.arange(ends[-1]) + np.repeat(places[found] - ends[:-1], size)]
                bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
                made = pa.Array.from_buffers(pa.large_string(), len(lists), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
                made = pa.compute.if_else(lists.is_valid(), made, pa.scalar(None, pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, into])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """``(key, n_pieces, pieces_sha256, lossless)``: each text encoded, decoded and compared."""
    coded = encode(df.select(key, text), "_coded", text, key, model).select(key, text, F.col("_coded.ids").alias("_ids"))
    back = decode(coded, "_ids", "_back", model)
    return back.select(
        key,
        F.size("_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("_ids", ","), 256).alias("pieces_sha256"),
        (F.coalesce(F.col(text), F.lit("")) == F.col("_back")).alias("lossless"),
    )

"""Language ID by bit-sliced Bloom filters of letter trigrams.

One table of bit masks holds a Bloom filter for each language: bit l of a slot
belongs to language l. The AND of an n-gram's slots is the set of all languages
that have it. A text's popcount for each language, less the false positives its
filter's fill leads one to expect, decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.frames import annotate, ship, shipped, struct_of
from textrep.llm.words import mix, slices, text_bounds

#: An n-gram is in a language's set at this share of the language's n-grams at least, so a set has 50,000 at most.
LEAST_SHARE = 2e-5
#: ... and at this part of the share it has in the language where it is most frequent.
LEAST_PART = 0.2
HASHES = 3
SLOTS_PER_GRAM = 16
UNKNOWN = "und"

LANGUAGE = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
COUNTED = "lang string, gram long, n long"


_known_letters: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _known_letters:
        _known_letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _known_letters[0]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, number of codes before each text)``: three letters or word borders, lower case.

    Anything but letters is a border; no trigram has a border in its middle.
    """
    data, bounds = text_bounds(pa.compute.utf8_lower(texts.fill_null("")))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    bounds = heads[bounds]
    # Each text gets a border in front and one behind.
    spread = np.zeros(len(points) + 2 * len(texts), np.int64)
    place = np.arange(len(points)) + 2 * np.repeat(np.arange(len(texts)), np.diff(bounds)) + 1
    spread[place] = np.where(_letters()[points], points, 0)
    if len(spread) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    middle = spread[1:-1]
    inside = np.flatnonzero(middle)
    codes = (spread[inside] << 42) | (middle[inside] << 21) | spread[inside + 2]
    return codes, np.searchsorted(inside + 1, bounds + 2 * np.arange(len(texts) + 1))


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``(lang, gram, n)`` over all rows; each task sums its own rows first."""

    def run(batches):
        held: dict[str, list] = {}

        def compact(name: str) -> None:
            codes = np.concatenate([c for c, _ in held[name]])
            sums = np.concatenate([n for _, n in held[name]])
            distinct, place = np.unique(codes, return_inverse=True)
            held[name] = [(distinct, np.bincount(place.reshape(-1), sums).astype(np.int64))]

        def emitted(name: str):
            compact(name)
            codes, sums = held.pop(name)[0]
            for at in range(0, len(codes), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes[part]), pa.string()), pa.array(codes[part]), pa.array(sums[part])], names=["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch, text):
                codes, first = trigrams(part.column(text))
                names = np.array(part.column(lang).to_pylist(), dtype=object)
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                for name in set(names.tolist()):
                    own = np.unique(codes[(names == name)[owner]], return_counts=True)
                    held.setdefault(name, []).append(own)
                    if sum(len(c) for c, _ in held[name]) > 1 << 20:
                        compact(name)
                        if len(held[name][0][0]) > 1 << 19:
                            yield from emitted(name)
        for name in list(held):
            yield from emitted(name)

    return docs.select(text, lang).mapInArrow(run, COUNTED).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filters:
    """Bit masks of all slots (slots x 64-bit words of languages), the names of the bits and their false-positive rates."""

    names: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def slots(self, codes: np.ndarray) -> list[np.ndarray]:
        spread = mix(codes.view(np.uint64))
        step = (spread >> np.uint64(32)) | np.uint64(1)
        return [((spread + np.uint64(i) * step) & np.uint64(len(self.masks) - 1)).astype(np.int64) for i in range(HASHES)]

    def languages(self, codes: np.ndarray) -> np.ndarray:
        """Mask of the languages of each n-gram."""
        a, *rest = self.slots(codes)
        out = self.masks[a]
        for b in rest:
            out &= self.masks[b]
        return out


def build_filters(names: list[str], codes: np.ndarray, lang: np.ndarray) -> Filters:
    size = 1 << int(np.ceil(np.log2(SLOTS_PER_GRAM * max(len(np.unique(codes)), 64))))
    made = Filters(names, np.zeros((size, max(-(-len(names) // 64), 1)), np.uint64), np.zeros(len(names)))
    bit = np.uint64(1) << (lang % 64).astype(np.uint64)
    for slot in made.slots(codes):
        np.bitwise_or.at(made.masks, (slot, lang // 64), bit)
    for i in range(len(names)):
        fill = np.mean((made.masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1))
        made.false_rate[i] = fill**HASHES
    return made


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", least_share: float = LEAST_SHARE, least_part: float = LEAST_PART) -> Filters:
    """Filters from all rows with a language and a text; only kept n-grams reach the driver."""
    counts = count_trigrams(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()), text, lang)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= least_share)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    kept = shares.join(most, "gram").where(F.col("share") >= F.col("most") * least_part).select("lang", "gram").toArrow()
    names = sorted(set(kept.column("lang").to_pylist()))
    rank = {name: i for i, name in enumerate(names)}
    return build_filters(names, kept.column("gram").to_numpy(), np.array([rank[x] for x in kept.column("lang").to_pylist()], np.int64))


def identify(texts: pa.Array, filters: Filters) -> pa.StructArray:
    codes, first = trigrams(texts)
    sizes = np.diff(first)
    filled = np.flatnonzero(sizes)
    found = np.zeros((len(texts), len(filters.names)))
    if len(filled) and filters.names:
        masks = filters.languages(codes)
        for i in range(len(filters.names)):
            bits = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            hits = np.add.reduceat(bits, first[filled])
            rate = filters.false_rate[i]
            found[filled, i] = np.maximum(hits - sizes[filled] * rate, 0) / (1 - rate)
    best = found.argmax(axis=1) if filters.names else np.zeros(len(texts), np.int64)
    known = (sizes > 0) & bool(filters.names)
    score = np.where(known, found[np.arange(len(texts)), best] / np.maximum(sizes, 1), 0.0) if filters.names else np.zeros(len(texts))
    names = np.array([*filters.names, UNKNOWN], dtype=object)
    return struct_of(lang=pa.array(names[np.where(known, best, len(filters.names))], pa.string()), score=pa.array(np.clip(score, 0.0, 1.0)))


def language(df: DataFrame, filters: Filters, into: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct ``into`` of ``lang`` and ``score``.

    ``score`` is the part of the text's n-grams, from 0 to 1, that the language
    has beyond chance. A null text, one without letters, or any text when
    nothing was learned is ``und`` with score 0; equal scores go to the first
    name in order.
    """
    sent = ship(df, filters)

    def start():
        known = shipped(sent)
        return lambda part: identify(part.column(text), known)

    return annotate(df, text, into, LANGUAGE, start, keep)

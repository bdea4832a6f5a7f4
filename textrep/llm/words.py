"""Words of whole texts as arrays: boundaries, hashes and hashes of word windows.

A task gets Arrow batches, cuts them into slices of a bounded number of bytes and
works on the bytes of a slice at once. All separators of the dealt operators are
ASCII, so words of UTF-8 bytes and words of characters are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: Words above this many bytes are hashed one by one.
LONG_WORD = 1 << 16

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: All of ASCII but digits and small letters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOW = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _power(base: np.uint64, size: int) -> np.ndarray:
    known = _powers.get(str(base))
    if known is None or len(known) < size:
        grown = np.full(max(size, SLICE_BYTES + LONG_WORD + 1), base, np.uint64)
        grown[0] = 1
        known = _powers[str(base)] = np.multiply.accumulate(grown)
    return known[:size]


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data`` and ``first``, the number of words before each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Place of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word; the work is cut into blocks of bytes."""
        out = np.empty(len(self.starts), np.uint64)
        sizes = self.ends - self.starts
        low, total = 0, len(out)
        while low < total:
            origin = self.starts[low]
            high = int(np.searchsorted(self.starts, origin + SLICE_BYTES, "left"))
            stop = int(min(self.ends[high - 1], origin + SLICE_BYTES + LONG_WORD))
            part = _BYTES[self.data[origin:stop]]
            part *= _power(_BASE, stop - origin)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            a = self.starts[low:high] - origin
            b = np.minimum(self.ends[low:high] - origin, stop - origin)
            out[low:high] = (sums[b] - sums[a]) * _power(_INVERSE, stop - origin)[a]
            low = high
        out += sizes.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        out = mix(out)
        for i in np.flatnonzero(sizes > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.word(i), digest_size=8).digest(), "little")
        return out

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """``(start word, hash)`` of every window of ``width`` words within one text."""
        starts = window_starts(self.first, width)
        return starts, window_hashes(hashes, width)[starts]


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    counts = np.maximum(np.diff(first) - width + 1, 0)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first[:-1], counts) + within


def window_hashes(hashes: np.ndarray, width: int, variant: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each word on, text borders not regarded."""
    total = max(len(hashes) - width + 1, 0)
    out = hashes[:total].copy()
    for step in range(1, width):
        out *= _WINDOW[variant]
        out += hashes[step : step + total]
    return mix(out)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most ``limit`` bytes, one row at least."""
    if batch.num_rows == 0:
        return
    bounds = text_bounds(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def text_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the borders of its texts; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        kind = np.int32
    elif pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        raise TypeError(f"texts are {texts.type}")
    _, places, data = texts.buffers()
    if len(texts) == 0 or places is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(texts: pa.Array, separators: np.ndarray, lower: bool) -> Words:
    """Maximal runs of bytes that are no separators, of each text."""
    data, bounds = text_bounds(texts)
    if lower:
        data = LOWER[data]
    inside = ~separators[data]
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        filled = bounds[1:] > bounds[:-1]
        heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
        opens[heads] = inside[heads]
        closes[tails] = inside[tails]
    starts = np.flatnonzero(opens)
    return Words(data, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, bounds))

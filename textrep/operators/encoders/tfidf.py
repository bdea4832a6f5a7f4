"""TF-IDF with truncated SVD.

Counting, weighting and normalising are ML transformers inside the JVM. The SVD
is a block power iteration: each step is one scan of the sparse rows against a
(features x components) matrix, whose size depends on the parameters alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    StopWordsRemover,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.functions.text import words
from textrep.functions.vectors import list_array, matrix
from textrep.operators.vocab import ranked_vocabulary, token_counts
from textrep.session import cut_lineage

# Size of the vocabulary and of the reduced vectors, extra
# components and number of power steps of the SVD.
MAX_FEATURES = 10_000
COMPONENTS = 300
OVERSAMPLE = 10
POWER_STEPS = 5
# Words with the smallest ids, the most frequent ones, whose weights are multiplied as a dense block.
DENSE_WORDS = 512
# Words whose partial sums travel as one row.
WORDS_PER_BLOCK = 128
SEED = 42


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def listed_words(
    texts: DataFrame, stop_words: Sequence[str] | None = None, text: str = "text", keep: Sequence[str] = ("row_id",)
) -> DataFrame:
    """``keep`` columns plus the ``words`` of each text, stop words removed."""
    found = texts.select(*keep, words(text).alias("found"))
    remover = StopWordsRemover(
        inputCol="found", outputCol="words", caseSensitive=True, locale="en_US",
        stopWords=english_stop_words() if stop_words is None else list(stop_words),
    )
    return remover.transform(found).drop("found")


def fit_weights(listed: DataFrame, max_features: int = MAX_FEATURES) -> tuple[PipelineModel, list[str]]:
    """Transformer from a ``words`` column to unit-length TF-IDF rows.

    The vocabulary is the ``max_features`` most frequent words (ties by word),
    so what reaches the driver is bounded by that parameter. The weight of a
    word is 1 + ln((1 + rows) / (1 + rows with the word)).
    """
    top = ranked_vocabulary(token_counts(listed, "words"), max_features)
    vocab = [row.token for row in top.orderBy("id").select("token").collect()]
    counter = CountVectorizerModel.from_vocabulary(vocab, inputCol="words", outputCol="counts")
    idf = IDF(inputCol="counts", outputCol="weighted").fit(counter.transform(listed))
    weights = Vectors.dense(np.asarray(idf.idf.toArray()) + 1.0)
    scale = ElementwiseProduct(scalingVec=weights, inputCol="counts", outputCol="weighted")
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="tfidf")
    return PipelineModel([counter, scale, unit]), vocab


def weigh(model: PipelineModel, listed: DataFrame, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """``keep`` columns plus the sparse row as ``indices`` and ``values``."""
    parts = F.unwrap_udt("tfidf")
    return model.transform(listed).select(*keep, parts["indices"].alias("indices"), parts["values"].alias("values"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


class _Slice:
    """Some sparse rows: the frequent words as a dense block, the others row by row, so that no product of all non-zero values is made."""

    def __init__(self, indices: np.ndarray, values: np.ndarray, offsets: np.ndarray, features: int) -> None:
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        often = indices < DENSE_WORDS
        self.head = np.zeros((len(offsets) - 1, min(DENSE_WORDS, features)))
        self.head[rows[often], indices[often]] = values[often]
        self.words, self.weights = indices[~often], values[~often]
        ends = np.r_[0, np.cumsum(~often)][offsets].tolist()
        self.filled = [(row, a, b) for row, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if a < b]

    def times(self, basis: np.ndarray) -> np.ndarray:
        """The rows times a dense matrix, rows without words giving zeros."""
        out = self.head @ basis[: self.head.shape[1]]
        for row, a, b in self.filled:
            out[row] += self.weights[a:b] @ basis.take(self.words[a:b], axis=0)
        return out

    def add_transposed(self, image: np.ndarray, total: np.ndarray) -> None:
        """``total`` plus the transposed rows times ``image``; a row has a word once."""
        total[: self.head.shape[1]] += self.head.T @ image
        for row, a, b in self.filled:
            total[self.words[a:b]] += self.weights[a:b, None] * image[row]


def _slices(indices: np.ndarray, values: np.ndarray, offsets: np.ndarray, features: int) -> Iterator[tuple[int, int, _Slice]]:
    for a, b in _row_slices(offsets):
        lo, hi = offsets[a], offsets[b]
        yield a, b, _Slice(indices[lo:hi], values[lo:hi], offsets[a : b + 1] - lo, features)


def _row_slices(offsets: np.ndarray, entries: int = 131_072, rows: int = 1_024) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``entries`` non-zero values each."""
    start = 0
    while start < len(offsets) - 1:
        stop = int(np.searchsorted(offsets, offsets[start] + entries, side="right")) - 1
        stop = min(max(stop, start + 1), start + rows, len(offsets) - 1)
        yield start, stop
        start = stop


def _gram_product(shared):
    """Task function: the partition's share of (rows^T rows) basis, in blocks of words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        total = np.zeros_like(basis)
        seen = False
        for batch in batches:
            indices, offsets = _lists(batch.column(0))
            values, _ = _lists(batch.column(1))
            seen = seen or bool(offsets[-1])
            for _, _, some in _slices(indices, values, offsets, len(basis)):
                some.add_transposed(some.times(basis), total)
        if seen:
            padded = np.zeros((_blocks(len(basis)) * WORDS_PER_BLOCK, basis.shape[1]))
            padded[: len(basis)] = total
            flat = padded.reshape(_blocks(len(basis)), -1)
            touched = np.flatnonzero(flat.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(touched, pa.int32()), list_array(flat[touched], pa.float64())], names=["block", "part"]
            )

    return scan


def _blocks(features: int) -> int:
    return -(-features // WORDS_PER_BLOCK)


def _gram_step(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(rows^T rows) basis: one scan, partial sums per task, one small shuffle."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(basis)
    # One partial matrix per task is shuffled, so many small splits are joined.
    tasks = rows.select("indices", "values").coalesce(context.defaultParallelism)
    parts = tasks.mapInArrow(_gram_product(shared), "block int, part array<double>")
    summed = parts.groupBy("block").agg(Summarizer.sum(array_to_vector("part")).alias("total"))
    table = summed.select("block", vector_to_array("total").alias("total")).toArrow()
    shared.unpersist()
    flat = np.zeros((_blocks(len(basis)), WORDS_PER_BLOCK * basis.shape[1]))
    if table.num_rows:
        flat[table.column(0).to_numpy()] = matrix(table.column(1))
    return flat.reshape(-1, basis.shape[1])[: len(basis)]


@dataclass
class Svd:
    """Right singular vectors (features x components) and singular values."""

    components: np.ndarray
    singular_values: np.ndarray


def truncated_svd(
    rows: DataFrame, features: int, components: int = COMPONENTS,
    steps: int = POWER_STEPS, oversample: int = OVERSAMPLE, seed: int = SEED,
) -> Svd:
    """Leading right singular vectors of the sparse rows, not centred.

    The sign of a component makes its largest loading positive.
    """
    count = rows.count()
    width = min(components, count, features)
    if width < 1:
        raise ValueError("the TF-IDF matrix has no features")
    block = min(features, width + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, block)))[0]
    for _ in range(steps):
        basis = np.linalg.qr(_gram_step(rows, basis))[0]
    image = _gram_step(rows, basis)
    inner = basis.T @ image
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(values)[::-1][:width]
    found = basis @ vectors[:, best]
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(width)])
    return Svd(found * np.where(sign == 0, 1, sign), np.sqrt(np.maximum(values[best], 0)))


def project(rows: DataFrame, svd: Svd, keep: Sequence[str] = ("row_id",), dtype: str = "float") -> DataFrame:
    """Sparse rows mapped onto the components as ``embedding``."""
    shared = rows.sparkSession.sparkContext.broadcast(svd.components)
    kept = [rows.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("embedding", T.ArrayType(T.FloatType() if dtype == "float" else T.DoubleType()))])
    arrow_type = pa.float32() if dtype == "float" else pa.float64()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = shared.value
        for batch in batches:
            n = len(keep)
            indices, offsets = _lists(batch.column(n))
            values, _ = _lists(batch.column(n + 1))
            for a, b, some in _slices(indices, values, offsets, len(basis)):
                image = some.times(basis)
                columns = [batch.column(i).slice(a, b - a) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, list_array(image, arrow_type)], names=[*keep, "embedding"]
                )

    return rows.select(*keep, "indices", "values").mapInArrow(scan, schema)


def encode(
    texts: DataFrame, components: int = COMPONENTS, max_features: int = MAX_FEATURES,
    stop_words: Sequence[str] | None = None, text: str = "text", keep: Sequence[str] = ("row_id",),
) -> tuple[DataFrame, PipelineModel, Svd]:
    """Fit on the whole table and map every row; also returns the fitted parts.

    Words and sparse rows are written for the repeated scans.
    """
    listed = cut_lineage(listed_words(texts, stop_words, text, keep), "words")
    model, vocab = fit_weights(listed, max_features)
    rows = cut_lineage(weigh(model, listed, keep), "sparse-rows")
    svd = truncated_svd(rows, len(vocab), components)
    return project(rows, svd, keep), model, svd

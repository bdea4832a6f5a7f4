"""Vectors from any user-supplied batch model.

A model is a function from a list of texts to a matrix. It is loaded once per
Python worker and fed batches of texts; a transformer network plugs in here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[Sequence[str]], np.ndarray]

HASH_DIM = 64
BATCH_SIZE = 256


def hashing_encoder(dim: int = HASH_DIM) -> Callable[[], Encoder]:
    """Factory of the built-in model: signed token counts at hashed places.

    The first eight hexadecimal digits of a token's MD5 give the place, the
    ninth the sign (odd is negative); rows are scaled to unit length.
    """

    def load() -> Encoder:
        def place(token: str) -> tuple[int, int]:
            digest = hashlib.md5(token.encode("utf-8")).hexdigest()
            return int(digest[:8], 16) % dim, -1 if int(digest[8], 16) % 2 else 1

        def encode(texts: Sequence[str]) -> np.ndarray:
            split = [text.split() for text in texts]
            flat = [token for tokens in split for token in tokens]
            number = {token: i for i, token in enumerate(dict.fromkeys(flat))}
            places = np.array([place(token) for token in number] or [(0, 0)])
            index = np.fromiter((number[token] for token in flat), np.int64, len(flat))
            row = np.repeat(np.arange(len(texts)), [len(tokens) for tokens in split])
            sums = np.bincount(row * dim + places[index, 0], places[index, 1], minlength=len(texts) * dim)
            out = sums.reshape(len(texts), dim)
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(length > 0, length, 1.0)).astype(np.float32)

        return encode

    return load


def encode(
    texts: DataFrame,
    make_encoder: Callable[[], Encoder] | None = None,
    text: str = "cleaned_text",
    keep: Sequence[str] = ("row_id",),
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """``keep`` columns plus ``embedding``; a null text is read as empty."""
    make_encoder = make_encoder or hashing_encoder()

    def make_predict():
        model = make_encoder()

        def predict(batch: np.ndarray) -> np.ndarray:
            return np.asarray(model([t if isinstance(t, str) else "" for t in batch]), np.float32)

        return predict

    vector = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    # Declared non-deterministic so that a later filter never runs the model twice.
    vector = vector.asNondeterministic()
    return texts.select(*keep, vector(F.coalesce(F.col(text), F.lit(""))).alias("embedding"))

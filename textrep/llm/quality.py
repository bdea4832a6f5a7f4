"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Log-count ratios of the n-grams come from all labelled rows. They scale the
indicators of a linear hinge-loss model, fitted by dual coordinate descent on a
bounded sample of the labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textrep.llm.frames import annotate, sent, ship, shipped, struct_of
from textrep.llm.words import BLANKS, NOT_ALNUM, mix, slices, split_words, window_hashes, window_starts

#: N-grams share this many places.
FEATURES = 1 << 18
#: Labelled rows that the linear model is fitted on, about; the ratios use all of them.
FIT_ROWS = 8000
#: Weight of the fitted coefficients against their mean.
BLEND = 0.25
SMOOTHING = 1.0
PENALTY = 1.0
PASSES = 20
THRESHOLD = 0.3
LABEL_BYTES = 32 << 20

SCORE = T.StructType([T.StructField("score", T.DoubleType())])

MARKS = BLANKS.copy()
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ALNUM_ONLY = NOT_ALNUM.copy()
ALNUM_ONLY[0x41:0x5B] = False


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram places of each text in order and their number before each text.

    N-grams are words, runs of marks, and pairs of blank-separated words; case is kept.
    """
    codes, owners = [], []
    for salt, separators, widths in ((1, ALNUM_ONLY, (1,)), (2, MARKS, (1,)), (3, BLANKS, (2,))):
        words = split_words(texts, separators, lower=False)
        hashes = words.hashes() + np.uint64(salt * 0x1E3779B97F4A7C15)
        for width in widths:
            starts = window_starts(words.first, width)
            codes.append(window_hashes(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64))
            owners.append(np.repeat(np.arange(len(texts)), np.maximum(words.counts - width + 1, 0)))
    place = (mix(np.concatenate(codes)) >> np.uint64(40)).astype(np.int64) & (FEATURES - 1)
    both = np.unique(np.concatenate(owners) * FEATURES + place)
    return both % FEATURES, np.searchsorted(both // FEATURES, np.arange(len(texts) + 1))


def count_labels(rows: DataFrame, text: str, label: str) -> DataFrame:
    """``(feature, negative, positive)``: texts that have the n-gram, by label; place -1 counts all texts."""

    def run(batches):
        sums = np.zeros((FEATURES + 1, 2), np.int64)
        for batch in batches:
            for part in slices(batch, text):
                place, first = indicators(part.column(text))
                labels = part.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(sums, (place, np.repeat(labels, np.diff(first))), 1)
                np.add.at(sums, (np.full(len(labels), FEATURES), labels), 1)
        found = np.flatnonzero(sums.any(axis=1))
        place = np.where(found == FEATURES, -1, found)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[found, 0]), pa.array(sums[found, 1])], names=["feature", "negative", "positive"])

    made = rows.select(text, label).mapInArrow(run, "feature long, negative long, positive long")
    return made.groupBy("feature").agg(F.sum("negative").alias("negative"), F.sum("positive").alias("positive"))


def descend(place: np.ndarray, first: np.ndarray, ratio: np.ndarray, sign: np.ndarray, cost: np.ndarray, passes: int, seed: int = 11) -> tuple[np.ndarray, float]:
    """Hinge-loss weights of scaled indicators (rows of length 1) and the intercept, by dual coordinate descent."""
    weights, intercept = np.zeros(FEATURES), 0.0
    rows = len(sign)
    values = ratio[place]
    norm = np.sqrt(np.add.reduceat(np.append(values * values, 0.0), np.minimum(first[:-1], len(values))) * (np.diff(first) > 0))
    values = values / np.repeat(np.where(norm > 0, norm, 1.0), np.diff(first))
    square = np.where(norm > 0, 2.0, 1.0)
    dual = np.zeros(rows)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(rows):
            at, x = place[first[i] : first[i + 1]], values[first[i] : first[i + 1]]
            slope = sign[i] * (weights[at] @ x + intercept) - 1.0
            new = min(max(dual[i] - slope / square[i], 0.0), cost[i])
            step = (new - dual[i]) * sign[i]
            if step:
                weights[at] += step * x
                intercept += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return weights, intercept


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the probability of label 1, by Newton steps with a small penalty on the slope."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    target = np.where(label > 0, (label.sum() + 1) / (label.sum() + 2), 1 / (len(label) - label.sum() + 2))
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6]), x.T @ (target - p) - np.array([1e-3, 1e-6]) * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Margin of rows whose scaled indicators have length 1."""
        ratio = self.ratio[place]
        sums, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (ratio * self.weights[place], ratio * ratio))
        length = np.sqrt(np.maximum(squares[first[1:]] - squares[first[:-1]], 0))
        return (sums[first[1:]] - sums[first[:-1]]) / np.where(length > 0, length, 1.0) + self.intercept

    def score(self, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(place, first) + self.shift, -500, 500)))


def learn(rows: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", fit_rows: int = FIT_ROWS) -> Model:
    """The model of label 1 against 0 from all rows; see ``FIT_ROWS``.

    Without rows of both labels all weights are 0, and the score is the share
    of label 1, or 0.5 without rows.
    """
    counts = count_labels(rows, text, label).toArrow()
    sums = np.zeros((FEATURES + 1, 2))
    sums[counts.column("feature").to_numpy()] = np.stack([counts.column("negative").to_numpy(), counts.column("positive").to_numpy()], axis=1)
    total, sums = sums[-1], sums[:-1]
    if not total.all():
        share = (total[1] + 1) / (total.sum() + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    smooth = sums + SMOOTHING
    ratio = np.log(smooth[:, 1] / smooth[:, 1].sum()) - np.log(smooth[:, 0] / smooth[:, 0].sum())
    share = min(1.0, fit_rows / total.sum())
    chance = F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))
    picked = rows.where(chance if share < 1 else F.lit(True))
    schema = T.StructType([T.StructField("place", T.ArrayType(T.IntegerType()))])

    def start():
        def work(part: pa.RecordBatch) -> pa.Array:
            place, first = indicators(part.column(text))
            return struct_of(place=pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(place, pa.int32())))

        return work

    sample = annotate(picked.select(key, text, label), text, "_i", schema, start, [key, label]).select(key, label, "_i.place").toArrow().sort_by(key)
    lists = sample.column("place").combine_chunks()
    first = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    place = lists.flatten().to_numpy().astype(np.int64)
    truth = sample.column(label).to_numpy().astype(np.int64)
    fit = np.arange(len(truth)) % 4 != 0
    model = Model(ratio, np.zeros(FEATURES), 0.0, 1.0, 0.0)
    own = np.diff(first)
    chosen, begin = place[np.repeat(fit, own)], np.concatenate([[0], np.cumsum(own[fit])])
    balance = np.where(truth == 1, len(truth) / (2 * max((truth == 1).sum(), 1)), len(truth) / (2 * max((truth == 0).sum(), 1)))
    if len(truth) and fit.any():
        weights, model.intercept = descend(chosen, begin, ratio, np.where(truth[fit] == 1, 1.0, -1.0), PENALTY * balance[fit], PASSES)
        used = np.zeros(FEATURES, bool)
        used[chosen] = True
        mean = np.abs(weights[used]).sum() / max(used.sum(), 1)
        model.weights = np.where(used, (1 - BLEND) * mean + BLEND * weights, mean)
        model.slope, model.shift = _calibrate(model.margin(place, first)[~fit], truth[~fit])
    return model


def quality(df: DataFrame, model: Model, into: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with a struct ``into`` of ``score``, the probability of label 1; a null text scores like an empty one."""
    known = ship(df, model)

    def start():
        found = shipped(known)
        return lambda part: struct_of(score=pa.array(found.score(*indicators(part.column(text)))))

    return annotate(df, text, into, SCORE, start, keep)


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """Rows with a label of 0 or 1 as ``label``; of several labels of one key the larger one holds."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    few = sent(marks, 16, LABEL_BYTES)
    return docs.join(marks if few is None else few, key)

"""Exact nearest neighbours of a query set in a table of vectors.

The queries travel, the table stays: a block of queries of a bounded size is
sent to every task, each task scans its part of the table once with matrix
products and keeps the best rows per query, and a rank over these few rows
ends the job. A query set above the bound is cut into several blocks, one scan
each; the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textrep.functions.vectors import matrix

BLOCK_BYTES = 64 << 20
CHUNK = 1024
# Vector entries that are gathered at once to compute the costs of listed pairs.
PAIR_VALUES = 4 << 20

_SCHEMA = "query_id long, row_id long, score double"


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def _first_k(query: np.ndarray, row: np.ndarray, cost: np.ndarray, k: int):
    """The k cheapest entries of every query, ties by row id."""
    order = np.lexsort((row, cost, query))
    query, row, cost = query[order], row[order], cost[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    best = place < k
    return query[best], row[best], cost[best]


def _exact_cost(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Costs of listed pairs, a bounded number of pairs at a time."""
    cost = np.empty(len(q))
    step = max(1, PAIR_VALUES // queries.shape[1])
    for start in range(0, len(q), step):
        part = slice(start, start + step)
        a, b = queries[q[part]], vectors[r[part]]
        cost[part] = -np.einsum("ij,ij->i", a, b) if metric == "cosine" else ((a - b) ** 2).sum(axis=1)
    return cost


def _nearest_in_task(shared, k: int, metric: str):
    """Task function: best ``k`` rows per query over all batches of a partition.

    Products pick the candidates with a small tolerance; their costs are then
    computed again pair by pair, so equal vectors have equal costs everywhere.
    A candidate behind the current last hit of its query, by cost or by row id
    among equals, is dropped at once, so a large group of copies adds no state.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        worst = np.full(len(ids), np.inf)
        worst_row = np.full(len(ids), np.iinfo(np.int64).max)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        square = (queries * queries).sum(axis=1)
        for batch in batches:
            all_rows, all_vectors = batch.column(0).to_numpy(), matrix(batch.column(1))
            if metric == "cosine":
                all_vectors = _unit(all_vectors)
            for start in range(0, len(all_rows), CHUNK):
                rows, vectors = all_rows[start : start + CHUNK], all_vectors[start : start + CHUNK]
                found = [best]
                for q0 in range(0, len(ids), CHUNK):
                    part = slice(q0, q0 + CHUNK)
                    product = queries[part] @ vectors.T
                    if metric == "cosine":
                        rough = -product
                    else:
                        rough = square[part, None] - 2 * product + (vectors * vectors).sum(axis=1)
                    slack = 1e-9 * (1.0 + np.abs(rough).max(initial=0.0))
                    limit = worst[part]
                    if len(rows) > k and not np.isfinite(limit).all():
                        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                    q, r = np.nonzero(rough <= (limit + slack)[:, None])
                    q = q + q0
                    cost = _exact_cost(queries, vectors, q, r, metric)
                    ahead = (cost < worst[q]) | ((cost == worst[q]) & (rows[r] < worst_row[q]))
                    found.append((q[ahead], rows[r[ahead]], cost[ahead]))
                best = _first_k(*(np.concatenate(c) for c in zip(*found)), k)
                query, row, cost = best
                if len(query):
                    last = np.flatnonzero(np.r_[query[1:] != query[:-1], True])
                    first = np.r_[0, last[:-1] + 1]
                    full = last[(last - first + 1) == k]
                    worst[query[full]], worst_row[query[full]] = cost[full], row[full]
        query, row, cost = best
        score = -cost if metric == "cosine" else cost
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[query]), pa.array(row), pa.array(score)], names=["query_id", "row_id", "score"]
        )

    return scan


def _query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query vectors on the driver, at most ``block_bytes`` per block."""
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    blocks = max(1, math.ceil((size[0] or 0) * (size[1] or 0) * 8 / block_bytes))
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        table = part.orderBy("query_id").toArrow()
        if table.num_rows:
            yield table.column(0).to_numpy(), matrix(table.column(1))


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "l2",
    key: str = "row_id",
    vector: str = "embedding",
    self_policy: str = "key",
    block_bytes: int = BLOCK_BYTES,
    tasks_per_core: int = 4,
) -> DataFrame:
    """``(query_id, row_id, rank, score)`` of the ``k`` nearest other rows.

    ``score`` is the squared distance for ``l2`` and the similarity for
    ``cosine``. ``self_policy="key"`` leaves out the row that is the query;
    ``"rank0"`` drops the first of k + 1 hits when it is the query, else the last.
    """
    context = base.sparkSession.sparkContext
    table = base.select(F.col(key).cast("long"), F.col(vector).cast("array<double>"))
    # One partial result per task is shuffled, so many small splits are joined.
    table = table.coalesce(max(1, context.defaultParallelism * tasks_per_core))
    asked = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    hits = None
    for ids, rows in _query_blocks(asked, block_bytes):
        shared = context.broadcast((ids, _unit(rows) if metric == "cosine" else rows))
        part = table.mapInArrow(_nearest_in_task(shared, k + 1, metric), _SCHEMA)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        raise ValueError("no queries")
    better = F.col("score").desc() if metric == "cosine" else F.col("score").asc()
    by_query = Window.partitionBy("query_id").orderBy(better, "row_id")
    rank = F.row_number().over(by_query)
    is_self = F.col("row_id") == F.col("query_id")
    if self_policy == "key":
        ranked = hits.filter(~is_self).withColumn("rank", rank)
    else:
        ranked = hits.withColumn("_r", rank).filter(F.col("_r") <= k + 1)
        first = F.max(is_self & (F.col("_r") == 1)).over(Window.partitionBy("query_id"))
        ranked = ranked.withColumn("rank", F.col("_r") - first.cast("int")).filter("rank >= 1")
    return ranked.filter(F.col("rank") <= k).select("query_id", "row_id", "rank", "score")

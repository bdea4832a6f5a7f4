"""Vector codes against a plain version with Python integers."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from textrep.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int, width int, code string, v string, n long"


def plain(rows, entries=16, parts=8, rounds=6):
    """Codes, errors, label errors and digests of ``(id, vector, label)`` rows, by width."""
    kept = [(i, [math.floor(4096 * x) if abs(x) < 1e300 else int(x) * 4096 for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    books = {}
    for width in {len(v) for _, v, _ in kept}:
        cut = [i * width // parts for i in range(parts + 1)]
        some = sorted((r for r in kept if len(r[1]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        books[width] = [[r[1][cut[p] : cut[p + 1]] for r in some[:entries]] for p in range(parts)]
        for _ in range(rounds):
            for p in range(parts):
                met = {}
                for _, v, _ in some:
                    part = v[cut[p] : cut[p + 1]]
                    met.setdefault(nearest(part, books[width][p])[1], []).append(part)
                for e, members in met.items():
                    books[width][p][e] = [sum(c) // len(members) for c in zip(*members)]
    out, by_label = [], {}
    for i, v, label in kept:
        cut = [p * len(v) // parts for p in range(parts + 1)]
        found = [nearest(v[cut[p] : cut[p + 1]], books[len(v)][p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        name = hashlib.sha256(",".join(str(x) for book in books[len(v)] for e in book for x in e).encode()).hexdigest()
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, label, name))
    return [(i, code, short(error), short(by_label[label]) if all(short(o[2]) is not None for o in out if o[3] == label) else None, name) for i, code, error, label, name in out]


def short(x):
    return x if x < 1 << 63 else None


def nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, v, label, 7, "x", "y", 1) for i, v, label in rows], SCHEMA).repartition(partitions)
    got = sorted(map(tuple, codes.compress(df).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)


def test_random_vectors_with_copies_nulls_and_ties(spark):
    random = np.random.default_rng(3)
    rows = [(i, (random.integers(-3, 4, 16) / 4).tolist(), int(i % 3) if i % 7 else None) for i in range(200)]
    rows += [(200 + i, rows[5][1], 1) for i in range(40)] + [(3, rows[9][1], 2), (None, rows[11][1], 2), (None, [0.1] * 16, 0)]
    rows += [(500, None, 1), (501, [None] + [0.0] * 15, 1), (502, [math.nan] * 16, 1), (503, [math.inf] + [0.0] * 15, 1), (504, [-0.0] * 16, 1)]
    check(spark, rows)


def test_widths_of_their_own(spark):
    random = np.random.default_rng(4)
    check(spark, [(i, random.normal(size=w).tolist(), 0) for i, w in enumerate([8] * 30 + [11] * 20 + [3] * 5 + [0] * 2)])


def test_numbers_beyond_a_long_are_exact(spark):
    random = np.random.default_rng(5)
    rows = [(i, (random.normal(size=16) * 10.0 ** random.integers(-3, 30)).tolist(), i % 2) for i in range(60)]
    rows += [(60 + i, random.normal(size=16).tolist(), 2) for i in range(20)] + [(90, [1e308] * 16, 3)]
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert codes.compress(df).count() == 0


def test_walk_shares_prefixes_over_windows(monkeypatch):
    monkeypatch.setattr(codes, "WINDOW", 7)
    random = np.random.default_rng(6)
    parts = np.unique(random.integers(-2, 3, (300, 5)), axis=0)
    book = random.integers(-2, 3, (16, 5))
    walk = codes.Walk(book)
    nearest_, far = walk.leaves(parts)
    assert [(int(d), int(e)) for d, e in zip(far, nearest_)] == [nearest(p, book.tolist()) for p in parts.tolist()]


def test_label_sums_keep_nulls_together(spark):
    random = np.random.default_rng(7)
    rows = [(i, random.normal(size=8).tolist(), None) for i in range(30)]
    df = spark.createDataFrame([(i, v, label, 7, "x", "y", 1) for i, v, label in rows], SCHEMA)
    got = codes.compress(df)
    assert got.select("label_error").distinct().count() == 1
    assert got.agg(F.sum("error")).first()[0] == got.first()["label_error"]

"""Substring dedup against a plain version, and the factors against the texts they name."""

import hashlib
import random
import re

import numpy as np
import pytest

from textrep.llm import substrings

BLOCK = 13


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows):
    """``(key, words, removed, sha)`` of each row by looking at every block."""
    lowest = {}
    for key, text in rows:
        w = words(text)
        for k in range(len(w) - BLOCK + 1):
            if key is not None:
                block = tuple(w[k : k + BLOCK])
                lowest[block] = min(lowest.get(block, key), key)
    out = []
    for key, text in rows:
        w, gone = words(text), set()
        for k in range(len(w) - BLOCK + 1):
            if key is not None and lowest[tuple(w[k : k + BLOCK])] < key:
                gone.update(range(k, k + BLOCK))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ID string").repartition(parts)
    got = substrings.remove_repeats(docs).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == plain(rows)
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append(words(text))
    for r in got:
        end = 0
        for f in r.factors or []:
            assert f.start >= end and f.length >= BLOCK and f.source < r.doc_id
            end = f.start + f.length
            copied = [w[f.source_start : f.source_start + f.length] for w in texts[f.source]]
            assert any(w[f.start : end] in copied for w in texts[r.doc_id])
    return got


def test_rows_that_share_a_key_are_told_apart(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(5, "other words " + " ".join(f"q{i}" for i in range(30))), (5, "start " + passage), (9, passage + " end of it"), (9, "tail " + passage)]
    rows += [(9, passage + " end of it"), (7, None), (7, ""), (None, passage), (8, passage + " more")]
    check(spark, rows)


def random_rows(seed, vocabulary, count):
    """Texts of few words, and of pieces of earlier texts, so that blocks overlap and repeat."""
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        w = [f"v{draw.randrange(vocabulary)}" for _ in range(draw.randrange(60))]
        for _ in range(draw.randrange(3) if rows else 0):
            other = words(draw.choice(rows)[1])
            at = draw.randrange(len(other) + 1)
            into = draw.randrange(len(w) + 1)
            w[into:into] = other[at : at + draw.randrange(40)]
        rows.append((draw.randrange(count), draw.choice([" ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("seed, vocabulary", [(1, 1), (2, 2), (3, 40), (4, 5000)])
def test_like_every_block(spark, seed, vocabulary):
    check(spark, random_rows(seed, vocabulary, 60))


def test_beyond_the_bounds_of_what_is_sent(spark, monkeypatch):
    for bound in ("MOST_ID_BYTES", "MOST_MARK_BYTES", "MOST_SPAN_BYTES"):
        monkeypatch.setattr(substrings, bound, 0)
    check(spark, random_rows(5, 300, 80))


def test_hot_segments_and_others(spark, monkeypatch):
    line = " ".join(f"l{i}" for i in range(25))
    rows = random_rows(6, 400, 40) + [(100 + i, f"a{i} {line} b{i}") for i in range(40)]
    for hot in (1, 30):
        monkeypatch.setattr(substrings, "HOT", hot)
        check(spark, rows)


def test_a_factor_is_the_longest_copy(spark):
    source = [f"s{i}" for i in range(60)]
    rows = [(1, " ".join(source)), (2, " ".join(["a", *source[10:40], "b", *source[30:60]]))]
    got = {r.doc_id: r for r in check(spark, rows)}
    assert [tuple(f) for f in got[2].factors] == [(1, 30, 1, 10), (32, 30, 1, 30)]


def test_blocks_across_the_end_of_a_factor():
    at = np.array([0, 1, 2, 3, 4, 9, 30])
    place = np.array([5, 6, 7, 100, 101, 50, 0])
    found = substrings.parse(at, np.array([1, 1, 1, 1, 1, 2, 2]), place, BLOCK)
    assert found == [(0, 15, 0, 22), (30, 43, 6, 43)]


def test_first_least_place():
    values = np.array([3, 1, 1, 2, 0, 5, 0, 7], np.uint64)
    assert substrings.least_runs(values, 3).tolist() == [int(i + np.argmin(values[i : i + 3])) for i in range(6)]

"""Steps whose tasks must stay small however large the table is."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textrep.operators.encoders import mean, w2v
from textrep.workload import reports


def test_raw_lines_in_order_over_many_files(spark, tmp_path):
    """One file held the whole table before."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("x")).repartition(3, F.col("id") % 7)
        reports._write_in_order(rows, "row_id", str(tmp_path / "raw"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(tmp_path.glob("raw/*.json"))
    assert len(files) > 1
    assert "".join(f.read_text() for f in files).split() == [f'{{"x":{3 * i}}}' for i in range(400)]


def test_files_of_a_stream_follow_the_table(spark, tmp_path):
    """There were four files whatever the table, each written by one task."""
    rows = spark.range(100).repartition(9)
    assert reports._write_for_batches(rows, str(tmp_path / "a")) == 3
    assert len(list(tmp_path.glob("a/*.json"))) == 9
    assert reports._write_for_batches(rows.coalesce(1), str(tmp_path / "b")) == 1


def test_only_rare_words_are_joined(spark, monkeypatch):
    """Short vectors once made room for any number of words in every task."""
    monkeypatch.setattr(mean, "MATRIX_ROWS", 1)
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0]), ("c", [6.0, 6.0])], "token string, vector array<double>")
    texts = spark.createDataFrame(
        [("x", ["a", "a", "b", "z"]), ("y", ["c", None]), ("z", ["b", "c"]), (None, None), ("w", [])] + [(f"v{i}", ["a", "z"]) for i in range(3)],
        "row_id string, tokens array<string>")
    got = {r.row_id: r.embedding for r in mean.encode(texts, "tokens", vectors, 2).collect()}
    want = {"x": [2 / 3, 1], "y": [6, 6], "z": [3, 4.5], None: [0, 0], "w": [0, 0], "v0": [1, 0], "v1": [1, 0], "v2": [1, 0]}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_rows_longer_than_a_batch_are_summed(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [4.0])], "token string, vector array<double>")
        texts = spark.createDataFrame([(i, ["a"] * 5 + ["b"] * i + ["c"] * 2) for i in range(8)], "row_id long, tokens array<string>")
        got = {r.row_id: r.embedding[0] for r in mean.encode(texts, "tokens", vectors, 1, matrix_bytes=4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: pytest.approx((5 + 2 * i + 8) / (7 + i)) for i in range(8)}


def test_draws_are_those_of_single_tokens():
    import numpy as np

    owner, places = np.array([0, 0, 1, 2]), np.array([0, 17, 3, 0])
    keys = ["x", None, 12]
    assert w2v._draws(keys, owner, places, 42).tolist() == [w2v.draw(keys[o], p, 42) for o, p in zip(owner, places)]


@pytest.mark.parametrize("name", ["word_vector_text", "stored_model", "tfidf_weights"])
def test_word_lists_are_written_not_cached(spark, tmp_path, name):
    """A cached partition of word lists has several times the bytes of its texts, and one task reads it."""
    from textrep.workload import all_queries

    texts = [(i, " ".join(f"word{(i * j) % 50} other{j}" for j in range(1, 9)), "en" if i % 2 else "de", "s") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = all_queries()[name](spark, str(tmp_path))
    assert "InMemoryTableScan" not in found._jdf.queryExecution().toString() and found.count()


def test_word2vec_vectors_stay_off_the_driver(spark):
    """Spark's trainer kept all weights there; words of a text with each other are closer, however many blocks train."""
    import numpy as np

    rng = np.random.default_rng(5)
    groups = [[f"{g}{i}" for i in range(10)] for g in "abc"]
    texts = [(i if i % 9 else None, " ".join(rng.choice(groups[i % 3], 15))) for i in range(300)]
    df = spark.createDataFrame(texts, "row_id long, cleaned_text string")
    for blocks in (1, 3):
        first, again = (
            {r.token: np.array(r.vector) for r in w2v.train(x, 8, epochs=8, partitions=blocks, sample=None).vectors.collect()}
            for x in (df, df.repartition(5)))
        assert first.keys() == {w for g in groups for w in g} and all((first[w] == again[w]).all() for w in first)
        unit = np.array([first[w] / np.linalg.norm(first[w]) for g in groups for w in g])
        near = (unit @ unit.T).reshape(3, 10, 3, 10).mean(axis=(1, 3))
        assert (np.diag(near) > 0.3 + near[~np.eye(3, dtype=bool)].max()).all()


def test_matrix_of_the_mean_reaches_the_tasks_piece_by_piece(spark, monkeypatch):
    """The driver held the whole matrix several times, 600 MB for 110,000 words."""
    import numpy as np

    rng = np.random.default_rng(6)
    vectors = {f"w{i}": rng.normal(size=5).astype(np.float32) for i in range(60)}
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vectors.items()], "token string, vector array<float>")
    texts = [(i, [f"w{j}" for j in rng.integers(0, 70, size=i)]) for i in range(40)]
    df = spark.createDataFrame(texts, "row_id long, tokens array<string>").coalesce(1)
    monkeypatch.setattr(mean, "SENT_BYTES", 200)
    monkeypatch.setattr(mean, "SLICE_ROWS", 7)
    sent = mean._sent(table, 5)
    assert len(sent) == 6 and sum(len(x.value[0]) for x in sent) == 60 and max(x.value[1].nbytes for x in sent) < 600
    for room in (1 << 20, 400):
        for r in mean.encode(df, "tokens", table, 5, matrix_bytes=room).collect():
            known = [vectors[w].astype(float) for w in texts[r.row_id][1] if w in vectors]
            assert r.embedding == pytest.approx(np.mean(known or [np.zeros(5)], axis=0).tolist(), abs=1e-6)


def test_word2vec_state_is_kept_in_the_width_it_is_trained_in():
    """Vectors trained as floats were stored as doubles, in tables rewritten each turn."""
    import numpy as np

    rng = np.random.default_rng(7)
    vectors, squares = rng.normal(size=(9, 4)).astype(np.float32), rng.random(9)
    column = w2v._state_bytes(vectors, squares)
    for part, low in ((column, 0), (column.slice(2), 2)):
        rows = w2v._state_rows(part, 4)
        assert (rows["vector"] == vectors[low:]).all() and (rows["squares"] == squares[low:]).all()
    assert column.nbytes < 9 * (4 * 4 + 8) + 100 and not len(w2v._state_rows(column.slice(9), 4))

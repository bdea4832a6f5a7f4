"""Index of keys: exact answers, few buckets read, repeated batches replaced."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textrep.operators import keyindex

KEYS = ("k", "v")


def rows(spark, numbers):
    return spark.createDataFrame([(f"key {i}", None if i % 7 == 0 else str(i)) for i in numbers], "k string, v string")


def names(df):
    return sorted(int(r.k.split()[1]) for r in df.collect())


def test_digest_tells_lengths_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "k string, v string")
    found = [bytes(r[0]) for r in df.select(keyindex.digest(df, KEYS)).collect()]
    assert found[0] == hashlib.sha256(b"2|1|ab|c").digest() and len(set(found)) == 3 and found[2] == found[3]


@pytest.mark.parametrize("filter_keys", [1 << 20, 5])
def test_batches_answer_as_a_set_would(spark, tmp_path, monkeypatch, filter_keys):
    monkeypatch.setattr(keyindex, "FILTER_KEYS", filter_keys)
    path, have = str(tmp_path / "index"), {}
    for batch, numbers in enumerate([range(0, 300), range(250, 400), [], range(0, 500, 3), range(1000, 1001)]):
        new, _ = keyindex.load(rows(spark, numbers), path, batch, KEYS, buckets=8)
        before = set().union(*(have[b] for b in range(batch))) if batch else set()
        have[batch] = set(numbers) - before
        assert names(new) == sorted(have[batch])
    stored = spark.read.schema(keyindex.KEYS).parquet(f"{path}/keys")
    assert stored.count() == stored.select("digest").distinct().count() == sum(map(len, have.values()))


def test_only_hit_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    keyindex.load(rows(spark, range(2000)), path, 0, KEYS, buckets=64)
    new, read = keyindex.load(rows(spark, range(5000, 7000)), path, 1, KEYS, buckets=64)
    assert new.count() == 2000 and len(read) <= 3
    new, read = keyindex.load(rows(spark, [5, *range(8000, 8100)]), path, 2, KEYS, buckets=64)
    assert new.count() == 100 and 1 <= len(read) <= 2
    digests = rows(spark, [6])
    found, read = keyindex.seen(digests.select(keyindex.digest(digests, KEYS).alias("digest")), path, 3, 64)
    assert found.count() == 1 and len(read) == 1
    keys = spark.read.schema(keyindex.KEYS).parquet(f"{path}/keys").filter((F.col("batch") < 3) & F.col("bucket").isin(read))
    assert "PartitionFilters: [isnotnull(batch" in keys._jdf.queryExecution().toString()
    assert keys.select(F.input_file_name()).distinct().count() <= 3


def test_repeated_batch_is_replaced(spark, tmp_path):
    path = str(tmp_path / "index")
    keyindex.load(rows(spark, range(10)), path, 0, KEYS)
    keyindex.load(rows(spark, range(5, 30)), path, 1, KEYS)
    for _ in range(2):
        new, _ = keyindex.load(rows(spark, range(5, 20)), path, 1, KEYS)
        assert names(new) == list(range(10, 20))
    new, _ = keyindex.load(rows(spark, range(30)), path, 2, KEYS)
    assert names(new) == list(range(20, 30))

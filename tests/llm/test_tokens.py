"""Token files against the tokenizer's own encoding of whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textrep.llm import tokens

SCHEMA = "doc_id long, text string, ids string, `key` long, n long, part long"
TEXTS = [
    (7, "It's a Test, of 12 words."), (3, None), (5, ""), (5, "same key"), (5, "same key"), (None, "no key"), (None, None), (9, " \t\x0b\n "),
    (1, "Größe ÀÉÎ ×÷ ª²½ \x85x\xa0y\x1cz"), (2, "Ελλάδα ΣΑΣ и ещё 漢字 é   don't 's"), (4, "<|endoftext|> <|startoftext|>x"),
    (6, "word " * 30000), (8, "x" * 70000 + " " + "é1" * 500), (10, "# # #"), (11, "\x00 \x001 ab"),
]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in TEXTS], SCHEMA).repartition(3)


def expected(model, end=2):
    coder = Tokenizer.from_str(model)
    return [(i, [*coder.encode(t or "", add_special_tokens=False).ids, end]) for i, t in TEXTS]


@pytest.mark.parametrize("block_ids", [1, 50, 1 << 14])
def test_files_give_back_all_ids(spark, docs, model, tmp_path, block_ids):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs, path, model, block_ids=block_ids)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    found = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    assert sorted(map(repr, found)) == sorted(map(repr, expected(model)))
    assert [r.n_tokens for r in got] == [len(ids) for _, ids in found]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    every = np.concatenate([ids for _, ids in found])
    assert [(r["id"], r["count"]) for r in ranks] == sorted(zip(*(x.tolist() for x in np.unique(every, return_counts=True))), key=lambda r: (-r[1], r[0]))
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert all(len(b.control) == -(-b.n // 4) and len(b.keys) == len(b.lengths) for b in blocks)
    # A block ends with the document that reaches its size.
    assert all(sum(b.lengths[:-1]) < block_ids for b in blocks)


def test_other_tokenizers_encode_whole_texts(spark, docs, tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = file.read()
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs, path, model, end=50256)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in tokens.read_tokens(spark, path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected(model, 50256)))


def test_empty_table(spark, docs, model, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs.limit(0), path, model)
    assert tokens.read_tokens(spark, path).count() == 0


def test_codes_of_every_size():
    random = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        ranks = (random.integers(0, 1 << 32, n) >> random.integers(0, 32, n)).astype(np.uint32)
        control, data = (np.frombuffer(b, np.uint8) for b in tokens.pack(ranks))
        assert (tokens.unpack(control, data, n) == ranks).all()
        assert len(data) - (-n % 4) == sum(max((int(r).bit_length() + 7) // 8, 1) for r in ranks)
    with pytest.raises(ValueError):
        tokens.unpack(control, data[:-1], n)


def test_query_against_plain_encoding(spark, folder, model):
    from textrep.llm import workload

    coder = Tokenizer.from_str(model)
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for r in rows:
        ids = np.array([*coder.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, workload.op11_token_files(spark, folder).collect())) == want

"""Hand-made cases for cleaning, formats, samples and token counts."""

import pytest
from pyspark.sql import functions as F

from textrep.functions import formats, text
from textrep.operators import sampling, select, vocab
from textrep.operators.dedup import first_of_each, unseen
from textrep.operators.preprocess import clean_reviews
from textrep.sources import runlogs
from textrep.sources.reviews import discover, label_column, normalize, read_reviews
from textrep.sources.wordvectors import parse_word_vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given,want", [
    ("a<br>b", "a b"), (None, ""), ("  a \t\n b  ", "a b"), ("a  b　", "a b"), ("x<a\nb>y", "x<a b>y"),
    ("a<b\rc>d", "a d"), ("<p>", ""), ("a  <i> b", "a b"),
])
def test_clean(spark, given, want):
    assert one(spark, text.clean_text(F.lit(given).cast("string"))) == want


def test_legacy_tags_leave_no_blank(spark):
    assert one(spark, text.squeeze(text.replace_tags(F.lit("a<br>b"), ""))) == "ab"


def test_cut(spark):
    long = " ".join(str(i) for i in range(257))
    assert one(spark, text.clean_text(F.lit(long), 256)) == " ".join(str(i) for i in range(256))
    assert one(spark, text.clean_text(F.lit(long))) == long


def test_tokens_match_python_split(spark):
    odd = "a\x1fb c \x85d e  f "
    assert one(spark, text.tokens(F.lit(odd))) == odd.split()
    assert one(spark, text.tokens(F.lit("  "))) == []


def test_words(spark):
    assert one(spark, text.words(F.lit("The café's a_1 x 42"), ["the"])) == ["café", "a_1", "42"]


def test_file_names(spark):
    names = {"amazon_reviews_All_Beauty_sample_10.jsonl": "All_Beauty", "other.jsonl": "other", "a.b.jsonl": "a.b"}
    for name, want in names.items():
        assert one(spark, formats.category_of_file(F.lit(name))) == want


@pytest.mark.parametrize("size,want", [(2335941728, "2.18 GB"), (512, "512 B"), (1024, "1.00 KB"), (128, "128 B"),
                                       (1152, "1.12 KB"), (1 << 52, "4096.00 TB")])
def test_human_bytes(spark, size, want):
    assert one(spark, formats.human_bytes(F.lit(size))) == want


@pytest.mark.parametrize("shown,want", [("5:08.61", 308.61), ("65:56:44", 237404.0), ("x", None), ("1:x", None), ("7", None)])
def test_duration(spark, shown, want):
    assert one(spark, formats.duration_seconds(F.lit(shown))) == want


@pytest.mark.parametrize("seconds,want", [(308.61, "5:08.61"), (237404.0, "65:56:44"), (60.0, "1:00"), (9.5, "0:09.5"), (None, None)])
def test_elapsed(spark, seconds, want):
    assert one(spark, formats.elapsed_text(F.lit(seconds).cast("double"))) == want


def reviews(spark, rows):
    return spark.createDataFrame(rows, "row_id long, rating string, text string, user_id string, parent_asin string, source_file string")


def test_clean_reviews(spark):
    rows = [
        (0, "5", "123456789", "u", None, "amazon_reviews_A_sample_1.jsonl"),
        (1, "bad", "1234567890", None, "p", "amazon_reviews_A_sample_1.jsonl"),
        (2, "4.0", "1234567890", "", "p", "amazon_reviews_B_sample_1.jsonl"),
        (3, None, "12345 67890", "u", "p", "b.jsonl"),
        (4, "1", "12345  67890", "u", "p", "b.jsonl"),
    ]
    got = clean_reviews(reviews(spark, rows), ["row_id"]).orderBy("row_id").collect()
    assert [(r.row_id, r.rating, r.category, r.cleaned_text) for r in got] == [
        (1, None, "A", "1234567890"), (3, None, "b", "12345 67890")]


def test_first_copy_does_not_depend_on_partitions(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("k"))
    for parts in (1, 5, 16):
        got = first_of_each(rows.repartition(parts), ["id"], ["k"])
        assert sorted(r.id for r in got.collect()) == list(range(7))


def test_hot_key_is_reduced_before_the_shuffle(spark):
    rows = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("k"))
    plan = first_of_each(rows, ["id"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_unseen(spark):
    old = spark.createDataFrame([("a", None), ("a", None)], "k string, v string")
    new = spark.createDataFrame([("a", ""), ("b", "x"), ("b", "x")], "k string, v string")
    assert [tuple(r) for r in unseen(new, old, ("k", "v")).collect()] == [("b", "x"), ("b", "x")]


def test_missing_columns_and_label(spark):
    got = normalize(spark.createDataFrame([("x.jsonl", "t")], "source_file string, text string")).first()
    assert got.title is None and got.verified_purchase is None and got.category == "x"
    assert label_column(spark.range(1).withColumn("rating", F.lit(1))) == "rating"


def test_raw_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path))
    (tmp_path / "plain.jsonl").write_text('{"rating": 3, "text": "one"}\n')
    assert [r.source_file for r in read_reviews(spark, str(tmp_path)).collect()] == ["plain.jsonl"]
    (tmp_path / "amazon_reviews_A_sample_2.jsonl").write_text(
        '{"rating": 5.0, "text": "two", "verified_purchase": true, "extra": 1}\nnot json\n')
    got = normalize(read_reviews(spark, str(tmp_path))).collect()
    assert {r.category for r in got} == {"A"} and got[0].rating == 5.0 and got[0].verified_purchase is True


def test_quotas_ties_go_to_the_later_label(spark):
    labels = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "l string")
    got = {r.l: r.quota for r in sampling.stratified_quotas(labels, "l", 5).collect()}
    assert got == {"a": 2, "b": 2, "c": 1}


def test_samples_are_exact_and_repeatable(spark):
    base = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("l"))
    for size in (0, 1, 777, 19_999, 20_000, 30_000):
        got = sampling.uniform_sample(base.repartition(3), size)
        rows = [r.row_id for r in got.collect()]
        assert len(rows) == len(set(rows)) == min(size, 20_000)
    one_way = {r.row_id for r in sampling.uniform_sample(base.repartition(7), 777).collect()}
    assert one_way == {r.row_id for r in sampling.uniform_sample(base, 777).collect()}
    train, test = sampling.train_test_split(base, "l")
    assert (train.count(), test.count()) == (16_000, 4_000) and not train.join(test, "row_id").count()


def test_first_per_group_of_a_hot_group(spark):
    base = spark.range(10_000).select("id", F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"))
    got = sampling.first_per_group(base.repartition(8), "g", ["id"], 20).collect()
    assert sorted(r.id for r in got if r.g == "b") == list(range(0, 200, 10)) and len(got) == 40


def test_top_share_and_quantile_flags(spark):
    flagged, threshold = select.flag_high(spark.range(1, 251), "id", 0.01)
    assert threshold == 249.0 and flagged.filter("flagged").count() == 2
    flagged, threshold = select.flag_low(spark.range(11), "id", 0.01)
    assert abs(threshold - 0.1) < 1e-12 and flagged.filter("flagged").count() == 1


def test_selection_with_ties_and_outliers(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(select, "SMALL", 50)
    values = np.r_[np.random.default_rng(1).normal(size=3000), np.full(1500, 0.25), [1e12, -1e9]]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = np.sort(values)
    for place in (0, 1, 30, 1700, 2600, 4500, 4501):
        assert select.nth_smallest(df, "v", place) == ordered[place]
    assert select.quantile(df, "v", 0.01) == pytest.approx(np.quantile(values, 0.01), abs=1e-12)


def cells(spark, ids, window):
    df = spark.createDataFrame([(0, ids)], "row_id long, ids array<int>")
    return {(r.row_id, r.col_id): r.value for r in vocab.cooccurrence(df, window).collect()}


def test_cooccurrence(spark):
    assert cells(spark, [0, 1, 0], 2) == {(0, 1): 2.0, (1, 0): 2.0, (0, 0): 1.0}
    assert cells(spark, [3], 5) == {} and cells(spark, [], 5) == {}


def test_unknown_tokens_go_before_the_window(spark):
    words = spark.createDataFrame([("a", 0), ("b", 1)], "token string, id int")
    texts = spark.createDataFrame([(0, ["a", "x", "b"]), (1, []), (2, ["x"])], "row_id long, tokens array<string>")
    ids = vocab.token_ids(texts, "tokens", words)
    got = {r.row_id: r.ids for r in ids.collect()}
    assert got == {0: [0, 1], 1: [], 2: []}
    assert {r.row_id: r.ids for r in vocab.joined_token_ids(texts, words).collect()} == got
    assert {(r.row_id, r.col_id): r.value for r in vocab.cooccurrence(ids, 1).collect()} == {(0, 1): 1.0, (1, 0): 1.0}


def test_vocabulary_ranks(spark):
    counts = spark.createDataFrame([("b", 3), ("a", 3), ("c", 9), ("d", 1)], "token string, cnt long")
    for cap in (3, 0):
        got = {r.token: r.id for r in vocab.ranked_vocabulary(counts, cap, 2).collect()}
        assert got == {"c": 0, "a": 1, "b": 2}
    with pytest.raises(ValueError):
        vocab.ranked_vocabulary(counts, 3, 10)


def test_word_vector_lines(spark):
    lines = [(0, "a 1 2"), (1, "new york 3 4"), (2, "short"), (3, "a 5 6  "), (4, "z 7 8")]
    df = spark.createDataFrame(lines, "at int, value string").select("at", F.split(F.rtrim("value"), " ").alias("parts"))
    known = spark.createDataFrame([("a",), ("new york",)], "token string")
    assert {r.token: r.vector for r in parse_word_vectors(df, 2, known).collect()} == {"a": [5, 6], "new york": [3, 4]}


def test_long_reviews_that_differ_late_are_both_kept(spark):
    head = " ".join(["word"] * 300)
    rows = [(i, "u", "c", f"{head} {end}") for i, end in enumerate(("one", "two", "two"))]
    raw = spark.createDataFrame(rows, "row_id long, user_id string, category string, text string")
    kept = clean_reviews(raw, ["row_id"]).orderBy("row_id").collect()
    assert [(r.row_id, r.cleaned_text) for r in kept] == [(0, f"{head} one"), (1, f"{head} two")]
    cut = clean_reviews(raw, ["row_id"], max_tokens=256).select("cleaned_text").collect()
    assert [len(r.cleaned_text.split()) for r in cut] == [256, 256]


def test_sample_ends_in_a_crowded_slice(spark):
    """Narrowing over several prefixes takes the same rows as one ranking."""
    rows = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("string").alias("g"))
    rows = rows.withColumn("g", F.when(F.col("row_id") < 5, None).otherwise(F.col("g")))
    data = [(r.g, r._h, r.row_id) for r in rows.withColumn("_h", sampling.hash_order("row_id")).collect()]
    for few in (0, 1, sampling.FEW):
        for size in (0, 1, 17, 700, 999, 5000):
            got = {r.row_id for r in sampling.mark_quota(rows, size, few=few).filter("taken").collect()}
            assert got == {k for _, _, k in sorted(data, key=lambda x: x[1:])[:size]}
    quotas = spark.createDataFrame([("true", 40), ("false", 1200)], "g string, quota int")
    got = {r.row_id for r in sampling.mark_quota(rows, quotas, ["g"], few=1).filter("taken").collect()}
    want = [sorted((h, k) for g, h, k in data if g == name)[:n] for name, n in (("true", 40), ("false", 1200))]
    assert got == {k for part in want for _, k in part}
    assert sampling.uniform_sample(rows.limit(0), 5).count() == 0


def test_log_lines_of_any_encoder(spark):
    lines = spark.createDataFrame(
        [("a/x.log", 1, 1, "Encode mine: 100%|####| 9/9 [01:10<00:00,  2.50s/it]"),
         ("a/x.log", 1, 2, "Encode other: 100%|####| 9/9 [0:20<00:00, 4.00row/s, loss=1]"),
         ("a/mine_2.log", 0, 1, "\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02:03.5"),
         ("a/mine_2.log", 0, 2, "\tElapsed (wall clock) time: none")],
        "path string, modified int, line_no int, line string")
    rows = {r.encoder: r for r in runlogs.encoder_runtimes(lines, runlogs.progress_labels(["mine", "other", "lost"])).collect()}
    assert set(rows) == {"mine", "other"}
    assert (rows["mine"].elapsed_seconds, rows["mine"].throughput_per_second) == (70.0, 0.4)
    assert (rows["other"].elapsed_seconds, rows["other"].throughput_per_second) == (20.0, 4.0)
    older = runlogs.encoder_runtimes(lines.filter("modified = 0"), runlogs.progress_labels(["mine"])).first()
    assert (older.elapsed_seconds, older.source) == (3723.5, runlogs.CLOCK_SOURCE)

"""Invariants of the vector operators against brute force on small inputs."""

import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textrep.operators import anomaly, classification, clustering, clustermetrics, histogram, knn, probe, projection, report, retrieval
from textrep.operators.encoders import batch, glove, mean, tfidf, w2v
from textrep.operators.sampling import uniform_sample
from textrep.sources import store
from textrep.streaming import reviews as stream

GOLDEN = {
    # Published confusion counts with accuracy, macro F1, weighted F1.
    "bge": ([[56257, 16448, 3799, 752, 1145], [23367, 36867, 15546, 1966, 969], [6920, 17388, 36423, 13928, 3194],
             [1425, 1573, 12078, 39582, 23032], [717, 211, 1336, 13988, 60413]],
            (0.5895911888298692, 0.584426253375675, 0.5839122824909735)),
    "sbert": ([[50678, 16845, 5017, 2561, 3300], [26287, 28371, 12559, 6733, 4765], [13568, 19306, 20063, 16072, 8844],
               [5825, 7763, 10732, 27132, 26238], [4258, 3434, 3518, 14341, 51114]],
              (0.45555372902775065, 0.44328254608635537, 0.4428435971193148)),
    "tfidf": ([[49859, 17820, 3443, 3017, 4262], [26649, 29523, 9968, 6650, 5925], [14198, 20044, 18181, 16257, 9173],
               [7596, 9206, 9746, 28816, 22326], [7210, 5209, 2860, 13834, 47552]],
              (0.446751291983027, 0.43505068371980815, 0.43464818159938795)),
}


def points(spark, rows=300, dim=6, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(rows, dim))
    data[rows - copies:] = data[0]
    frame = [(i, data[i].tolist(), i % 3, float(1 + i % 5)) for i in range(rows)]
    return spark.createDataFrame(frame, "row_id long, embedding array<double>, label int, rating double"), data


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_published_scores(spark, name):
    counts, want = GOLDEN[name]
    rows = [(t + 1, p + 1, n) for t, line in enumerate(counts) for p, n in enumerate(line)]
    got = classification.overall_scores(spark.createDataFrame(rows, "truth int, pred int, n long")).first()
    assert tuple(got) == pytest.approx(want, abs=1e-12)


def test_identical_partitions_and_symmetry(spark):
    same = spark.createDataFrame([(i % 3, "abc"[i % 3]) for i in range(30)], "label int, cluster string")
    assert tuple(clustermetrics.agreement(clustermetrics.contingency(same)).first()) == pytest.approx((1.0, 1.0))
    single = spark.createDataFrame([(1, 1)] * 4, "label int, cluster int")
    assert tuple(clustermetrics.agreement(clustermetrics.contingency(single)).first()) == (1.0, 1.0)
    other = spark.createDataFrame([(i % 3, i % 4 % 3) for i in range(40)], "label int, cluster int")
    one = clustermetrics.agreement(clustermetrics.contingency(other)).first()
    two = clustermetrics.agreement(clustermetrics.contingency(other, "cluster", "label")).first()
    assert tuple(one) == pytest.approx(tuple(two))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_neighbours_equal_brute_force(spark, metric):
    df, data = points(spark, copies=100)
    if metric == "l2":
        cost = ((data[:, None] - data[None]) ** 2).sum(-1)
    else:
        unit = data / np.linalg.norm(data, axis=1, keepdims=True)
        cost = -np.round(unit @ unit.T, 12)
    np.fill_diagonal(cost, np.inf)
    want = {q: sorted(range(len(data)), key=lambda r: (round(cost[q, r], 12), r))[:7] for q in range(len(data))}
    for parts, block in ((1, 1 << 20), (5, 3000)):
        hits = knn.nearest(df, df.repartition(parts), 7, metric, block_bytes=block).collect()
        got = {}
        for h in sorted(hits, key=lambda h: h["rank"]):
            got.setdefault(h.query_id, []).append(h.row_id)
        assert got == want


def test_rank0_policy_drops_the_last_when_a_copy_is_first(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [5.0])], "row_id long, embedding array<double>")
    got = {(h.query_id, h["rank"]): h.row_id for h in knn.nearest(df, df, 1, self_policy="rank0").collect()}
    assert got == {(0, 1): 1, (1, 1): 0, (2, 1): 0}


def test_precision_and_reciprocal_rank(spark):
    rows = [(9, i, i + 1, bool(m)) for i, m in enumerate([0, 1, 1, 0, 1])]
    one = spark.createDataFrame(rows, "query_id long, row_id long, rank int, match boolean")
    got = retrieval.per_query(one, (5, 10)).first()
    assert (got.precision_5, got.precision_10, got.reciprocal_rank) == (0.6, 0.6, 0.5)
    assert retrieval.per_query(one, (10,), divide_by_k=True).first().precision_10 == 0.3


def test_silhouette_equals_brute_force(spark):
    df, data = points(spark, 90)
    own = np.arange(90) % 3
    distance = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    widths = []
    for i in range(90):
        means = [distance[i, (own == c) & (np.arange(90) != i)].mean() for c in range(3)]
        a, b = means[own[i]], min(m for c, m in enumerate(means) if c != own[i])
        widths.append((b - a) / max(a, b))
    for block in (1 << 20, 2000):
        got = clustermetrics.silhouette_of_sample(df, "label", block_bytes=block).first()
        assert got.silhouette == pytest.approx(np.mean(widths), abs=1e-9) and got.sample_size == 90
    assert clustermetrics.silhouette_of_sample(df.withColumn("c", F.lit(0)), "c").first().silhouette is None


def test_silhouette_of_all_rows_equals_brute_force(spark):
    df, data = points(spark, 90)
    own = np.append(np.arange(89) % 3, 7)
    apart = ((data[:, None] - data[None]) ** 2).sum(-1)
    widths = []
    for i in range(89):
        means = [apart[i, (own == c) & (np.arange(90) != i)].mean() for c in (0, 1, 2, 7)]
        a, b = means[own[i]], min(m for c, m in enumerate(means) if c != own[i])
        widths.append((b - a) / max(a, b))
    rows = df.withColumn("cluster", F.when(F.col("row_id") == 89, 7).otherwise(F.col("row_id") % 3))
    far = rows.withColumn("embedding", F.transform("embedding", lambda x: x + 1e6))
    for some in (rows, far):
        got = clustermetrics.silhouette_of_all(some.repartition(3)).first()
        assert got.silhouette == pytest.approx(sum(widths) / 90, abs=1e-6) and got.sample_size == 90
    assert clustermetrics.silhouette_of_all(rows.withColumn("cluster", F.lit(0))).first().silhouette is None
    assert clustermetrics.silhouette_of_all(rows.limit(0)).first().sample_size == 0


def test_analysis_without_category_falls_back_to_the_rating(spark, tmp_path):
    from textrep.plans import analyse, encode

    texts = spark.createDataFrame([(i, f"some words {i % 3} here", float(1 + i % 3)) for i in range(40)], "row_id long, cleaned_text string, rating double")
    rows = encode.batch_build(texts, batch.hashing_encoder())()
    assert rows.columns == ["row_id", "rating", "embedding"]
    folder, results = str(tmp_path / "vectors"), str(tmp_path / "results")
    rows.write.parquet(f"{folder}/hashing")
    analyse.run_clustering(spark, folder, "hashing", results)
    analyse.run_retrieval(spark, folder, "hashing", results)
    found = {(r.task, r.label_column) for r in analyse.read_label_columns(spark, results).collect()}
    assert found == {("clustering", "rating"), ("retrieval", "rating")}
    assert store.read_metrics(spark, f"{results}/metrics").filter("metric = 'n_clusters'").first().value == 3


def test_histogram_equals_numpy(spark):
    values = np.r_[np.random.default_rng(0).normal(size=500), [0.0, 0.1, 0.2, 0.3]]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = histogram.smoothed(histogram.histogram(df, "v")).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=80)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.centre for r in rows] == pytest.approx(((edges[:-1] + edges[1:]) / 2).tolist())
    assert [r.smooth for r in rows] == pytest.approx(np.convolve(counts, histogram.kernel(), mode="same").tolist())


def test_svd_spans_the_leading_subspace(spark):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(rng.choice([f"word{j}" for j in range(40)], size=12, p=np.arange(1, 41) / 820))) for i in range(200)]
    df = spark.createDataFrame(texts, "row_id long, text string")
    rows, model, svd = tfidf.encode(df, components=5, max_features=30)
    words = model.stages[0].vocabulary
    dense = np.zeros((200, 30))
    for r in tfidf.weigh(model, tfidf.listed_words(df)).collect():
        dense[r.row_id, r.indices] = r["values"]
    assert np.linalg.norm(dense, axis=1) == pytest.approx(np.ones(200)) and len(words) == 30
    _, values, vectors = np.linalg.svd(dense)
    assert svd.singular_values[:3] == pytest.approx(values[:3], rel=1e-3)
    assert np.abs(svd.components[:, 0] @ vectors[0]) == pytest.approx(1.0, abs=1e-6)
    got = {r.row_id: r.embedding for r in rows.collect()}
    assert got[7] == pytest.approx((dense[7] @ svd.components).tolist(), abs=1e-5)


def test_svd_products_without_a_row_for_each_value(monkeypatch):
    """Each non-zero value cost two rows of the basis in memory: 12 microseconds, now 1.4."""
    rng = np.random.default_rng(11)
    dense = rng.random((60, 30)) * (rng.random((60, 30)) < 0.2)
    dense[7] = 0
    offsets, indices = np.cumsum(np.r_[0, (dense > 0).sum(axis=1)]), np.nonzero(dense)[1]
    basis = rng.normal(size=(30, 4))
    for often in (0, 9, 512):
        monkeypatch.setattr(tfidf, "DENSE_WORDS", often)
        parts, total = list(tfidf._slices(indices, dense[dense > 0], offsets, 30)), np.zeros((30, 4))
        for _, _, part in parts:
            part.add_transposed(part.times(basis), total)
        assert total == pytest.approx(dense.T @ dense @ basis)
        assert np.concatenate([part.times(basis) for _, _, part in parts]) == pytest.approx(dense @ basis)
    assert list(tfidf._row_slices(np.array([0, 5, 5, 5, 9, 30]), 6, 2)) == [(0, 2), (2, 4), (4, 5)]


def test_mean_of_known_tokens(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "token string, vector array<double>")
    texts = spark.createDataFrame([(0, ["a", "a", "b", "z"]), (1, ["z"]), (2, [])], "row_id long, tokens array<string>")
    for room in (1 << 20, 8):
        got = {r.row_id: r.embedding for r in mean.encode(texts, "tokens", vectors, 2, matrix_bytes=room).collect()}
        assert got[0] == pytest.approx([2 / 3, 1.0]) and got[1] == got[2] == [0.0, 0.0]
    with pytest.raises(ValueError):
        mean.check_dimension(vectors, 3)


def test_trained_vectors(spark):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(rng.choice(list("abcdefgh"), size=20))) for i in range(60)]
    df = spark.createDataFrame(texts, "row_id long, cleaned_text string")
    model = w2v.train(df, size=4, epochs=1)
    got = w2v.encode(df.union(spark.createDataFrame([(99, "a unseen")], df.schema)), model)
    vector = {r.token: r.vector for r in w2v.word_vectors(model).collect()}["a"]
    assert {r.row_id: r.embedding for r in got.collect()}[99] == pytest.approx(vector)
    with pytest.raises(ValueError):
        w2v.train(df, min_count=10_000)


def test_frequent_words_are_thinned_by_their_counts(spark):
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(rng.choice(["the", "of", *[f"w{j}" for j in range(400)]], 50, p=[0.3, 0.1, *[0.6 / 400] * 400]))) for i in range(300)] + [(900, ""), (901, None)]
    df = spark.createDataFrame(texts, "row_id long, cleaned_text string")
    count = Counter(w for _, t in texts for w in (t or "").split())
    threshold = 0.01 * sum(c for c in count.values() if c >= 5)
    chance = {w: (np.sqrt(c / threshold) + 1) * threshold / c for w, c in count.items()}
    want = {i: [w for p, w in enumerate((t or "").split()) if count[w] < 5 or chance[w] >= 1 or w2v.draw(i, p, 42) < chance[w]] for i, t in texts}
    for parts in (1, 5):
        got = {r.row_id: r.tokens for r in w2v.training_tokens(df.repartition(parts), sample=0.01).collect()}
        assert {k: v or [] for k, v in got.items()} == want
    share = sum(v.count("the") for v in want.values()) / count["the"]
    assert share == pytest.approx(chance["the"], abs=0.03) and share < 0.3
    assert w2v.training_tokens(df, sample=None).agg(F.sum(F.size("tokens"))).first()[0] == sum(count.values())


def test_thinning_keeps_the_vocabulary(spark):
    """Five occurrences of a word that is frequent in a tiny table all stay."""
    df = spark.createDataFrame([(i, "a b c") for i in range(5)], "row_id long, cleaned_text string")
    assert sum((r.tokens for r in w2v.training_tokens(df, sample=1e-3).collect()), []).count("a") == 5
    assert (w2v.parts_for(0), w2v.parts_for(1), w2v.parts_for(1_000_001)) == (1, 1, 3)


@pytest.fixture(scope="module")
def letters(spark):
    from textrep.operators import vocab

    rng = np.random.default_rng(2)
    texts = [(i, rng.choice(list("abcdefghijkl"), size=30).tolist()) for i in range(80)]
    df = spark.createDataFrame(texts, "row_id long, tokens array<string>")
    top = vocab.ranked_vocabulary(vocab.token_counts(df, "tokens"), 50, 1).persist()
    return top, vocab.cooccurrence(vocab.token_ids(df, "tokens", top), 3).persist()


def plain_glove(spark, cells, words, size, epochs, subspace):
    """The sweeps on whole matrices, word after word; ``subspace`` entries are solved exactly, given the others."""
    counts = np.zeros((words, words))
    for r in cells.collect():
        counts[r.row_id, r.col_id] = r.value
    sides = []
    for seed in (42, 43):
        rows = sorted(glove.first_side(spark, words, size, seed).collect())
        sides.append(np.array([[*r.vector, 0.0] for r in rows]))
    penalty, losses = np.diag([*[glove.RIDGE] * size, glove.BIAS_RIDGE]), []
    for _ in range(epochs):
        for s in (0, 1):
            loss = 0.0
            for i in range(words):
                js = np.flatnonzero(counts[i])
                if not len(js):
                    continue
                design = np.column_stack([sides[1 - s][js, :-1], np.ones(len(js))])
                weights, targets = np.minimum((counts[i, js] / 100) ** 0.75, 1), np.log(counts[i, js]) - sides[1 - s][js, -1]
                x = sides[s][i]
                for low in range(0, size + 1, subspace):
                    some = np.arange(low, min(low + subspace, size + 1))
                    rest = targets - np.delete(design, some, 1) @ np.delete(x, some)
                    x[some] = np.linalg.solve((design[:, some].T * weights) @ design[:, some] + penalty[np.ix_(some, some)], (design[:, some].T * weights) @ rest)
                loss += float(weights @ (design @ x - targets) ** 2)
        losses.append(loss / int((counts > 0).sum()))
    return sides[0][:, :-1] + sides[1][:, :-1], losses


@pytest.mark.parametrize("subspace, options", [
    (5, {"parts": 1}), (5, {"parts": 7}), (2, {}), (5, {"group": 5, "parts": 3}), (5, {"group": 1, "parts": 2}),
])
def test_glove_equals_sweeps_on_whole_matrices(spark, letters, subspace, options):
    top, cells = letters
    model = glove.train(cells, 14, size=4, epochs=4, tolerance=-1, subspace=subspace, **options)
    vectors, losses = plain_glove(spark, cells, 14, 4, 4, subspace)
    assert model.losses == pytest.approx(losses, rel=1e-6)
    got = {r.id: r.vector for r in model.vectors.collect()}
    assert np.array([got[i] for i in range(14)]) == pytest.approx(vectors, abs=1e-5)


def test_glove_loss_falls_until_it_hardly_does(spark, letters):
    top, cells = letters
    model = glove.train(cells, 12, size=4, tolerance=0.05)
    assert all(b <= a * 1.001 for a, b in zip(model.losses, model.losses[1:])) and 1 < len(model.losses) < glove.EPOCHS
    assert {r.token for r in glove.word_vectors(model, top).collect()} == set("abcdefghijkl")
    with pytest.raises(ValueError):
        glove.train(cells.limit(0), 12, size=4)


def test_glove_normal_equations_with_more_cells_than_entries(spark):
    """Rows of many cells are sent as sums of products, short ones as they are."""
    rng = np.random.default_rng(8)
    rows = [(i, j, float(rng.integers(1, 9))) for i in range(30) for j in range(30) if i < 3 or j < 3]
    cells = spark.createDataFrame(rows, "row_id int, col_id int, value double")
    split = glove.train(cells, 31, size=3, epochs=3, tolerance=-1, group=8, parts=2)
    assert split.losses == pytest.approx(plain_glove(spark, cells, 31, 3, 3, 4)[1], rel=1e-6)


def test_user_model_plugs_in(spark):
    def load():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], np.float32)

    df = spark.createDataFrame([(0, "banana"), (1, None)], "row_id long, cleaned_text string")
    assert {r.row_id: r.embedding for r in batch.encode(df, load).collect()} == {0: [6.0, 3.0], 1: [0.0, 0.0]}


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=3) + 50 * (i % 4)).tolist(), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label int")
    assigned, scores = clustering.evaluate_clustering(df, "label")
    assert assigned.count() == 400 and scores.first().n_clusters == 4
    found = clustering.mini_batch_kmeans(df, 4, ("row_id", "label"), batch_rows=100, passes=2)
    pairs = found.groupBy("cluster", "label").count().collect()
    assert len(pairs) == 4 and {r["count"] for r in pairs} == {100}


def test_mini_batches_equal_numpy_on_the_same_draws(spark):
    df, data = points(spark, 300)
    k, seed, rounds = 5, 11, 3
    rows = df.select("row_id", F.col("embedding").alias("_v"), *[clustering.draw("row_id", seed, s).alias(f"u{s}") for s in range(5)],
                     F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(rounds)).alias("batch")).orderBy("row_id").collect()
    first = uniform_sample(df, 1, "row_id", seed).first().row_id
    centres = data[[first]]
    for step in range(5):
        far = ((data[:, None] - centres[None]) ** 2).sum(-1).min(axis=1)
        picked = [i for i, r in enumerate(rows) if r[f"u{step}"] < 2 * k * far[i] / far.sum()]
        centres = np.unique(np.concatenate([centres, data[picked]]), axis=0)
    own = ((data[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
    centres = clustering.choose(centres, np.bincount(own, minlength=len(centres)).astype(float), k, seed)
    assert clustering.spread_centres(df.withColumn("_v", F.col("embedding")), k, "row_id", seed) == pytest.approx(centres)
    weight, centres = np.zeros(k), centres.copy()
    for number in range(rounds):
        some = data[[r.batch == number for r in rows]]
        own = ((some[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
        for c in set(own):
            weight[c] += (own == c).sum()
            centres[c] += (some[own == c].mean(axis=0) - centres[c]) * (own == c).sum() / weight[c]
    want = ((data[:, None] - centres[None]) ** 2).sum(-1).argmin(axis=1)
    for parts in (1, 4):
        got = clustering.mini_batch_kmeans(df.repartition(parts), k, batch_rows=10, seed=seed, rounds=rounds).orderBy("row_id").collect()
        assert [r.cluster for r in got] == want.tolist()


def test_mini_batches_of_copies_and_of_nothing(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(50)], "row_id long, embedding array<double>")
    assert clustering.mini_batch_kmeans(df, 4).select("cluster").distinct().count() == 2
    assert clustering.mini_batch_kmeans(df.limit(0), 4).count() == 0


def test_forest_finds_the_far_point_on_any_partitioning(spark):
    df, data = points(spark, 400)
    far = spark.createDataFrame([(1000, [30.0] * 6, 0, 1.0)], df.schema)
    scores = []
    for parts in (1, 6):
        table = df.union(far).repartition(parts)
        got = anomaly.isolation_scores(table, 0.01, trees=20, rows_per_tree=64)
        scores.append({r.row_id: r.iso_score for r in got.collect()})
    assert scores[0] == pytest.approx(scores[1]) and min(scores[0], key=scores[0].get) == 1000
    assert anomaly.average_path(np.array([1, 2, 256.0]))[:2].tolist() == [0.0, 1.0]


def test_ridge_form_equals_the_closed_form(spark):
    df, data = points(spark, 120, 4)
    y = 1.0 + np.arange(120) % 5
    centred = data - data.mean(0)
    weights = np.linalg.solve(centred.T @ centred + np.eye(4), centred.T @ (y - y.mean()))
    want = y.mean() + centred @ weights
    got, _ = anomaly.rating_inconsistencies(df, 0.05, ridge=1.0)
    rows = {r.row_id: r for r in got.collect()}
    assert [rows[i].predicted_rating for i in range(120)] == pytest.approx(want.tolist(), abs=1e-6)
    assert sum(r.inconsistent for r in rows.values()) == 6


def test_probe_separates_and_keeps_the_classes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=3) * 0.1 + np.eye(3)[i % 3] * 3).tolist(), float(i % 3 + 1)) for i in range(150)]
    df = spark.createDataFrame([*rows, (500, [0.0] * 3, None)], "row_id long, embedding array<double>, rating double")
    for multinomial in (False, True):
        table, scores = probe.evaluate_probe(df, "rating", multinomial=multinomial)
        assert table.agg(F.sum("n")).first()[0] == 30 and scores.first().accuracy == 1.0


def test_projection_matches_principal_components(spark):
    df, data = points(spark, 100, 5)
    got = {r.row_id: r.embedding for r in projection.reduce_dimensions(df, 2).collect()}
    _, _, axes = np.linalg.svd(data - data.mean(0), full_matrices=False)
    mine = np.array([got[i] for i in range(100)])
    assert np.abs(mine) == pytest.approx(np.abs(data @ axes[:2].T), abs=1e-8)
    sample = projection.comparison(df, "label", sample_size=31)
    assert sample.count() == 31


def test_interrupted_store_is_rebuilt(spark, tmp_path):
    path = str(tmp_path / "vectors")
    df, _ = points(spark, 20, 3)
    rows = df.select("row_id", "embedding")
    store.write_embeddings(rows.limit(10), path, "x", 20, 3)
    assert not store.reusable(spark, path, 20, 3)
    _, reused = store.materialize(spark, path, "x", 20, 3, lambda: rows)
    assert not reused and store.reusable(spark, path, 20, 3) and not store.reusable(spark, path, 20, 4)
    assert store.reusable(spark, path, 20, 10, at_most=True)
    with pytest.raises(Exception, match="4 entries expected"):
        store.write_embeddings(rows, path, "x", 20, 4)


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    lines = spark.range(300).select(
        F.lit(3).alias("rating"), F.concat(F.lit("some text number "), F.col("id") % 40).alias("text"),
        F.concat(F.lit("u"), F.col("id") % 2).alias("user_id"))
    lines.repartition(5).write.json(source)
    for _ in range(2):
        stream.write_stream(stream.clean_stream(stream.read_review_stream(spark, source, 1)), out, state).awaitTermination()
        lines.limit(50).write.mode("append").json(source)
    got = [tuple(r) for r in spark.read.parquet(out).select("user_id", "cleaned_text").collect()]
    want = {tuple(r) for r in lines.select("user_id", F.col("text")).collect()}
    assert len(got) == len(want) and set(got) == want


def test_stream_load_keeps_the_first_copy(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def put(name, lines):
        rows = [f'{{"rating": {r}, "text": "{t}", "user_id": "u"}}' for r, t in lines]
        (tmp_path / "in" / name).write_text("\n".join(rows) + "\n")

    put("a.jsonl", [(1, "the first long text"), (2, "the first long text"), (3, "short")])
    put("b.jsonl", [(4, "the first long text"), (5, "the second long text")])
    stream.load_reviews(spark, source, out, state).awaitTermination()
    put("c.jsonl", [(3, "the second long text"), (2, "the third long text"), (1, "the third long text")])
    for _ in range(2):
        stream.load_reviews(spark, source, out, state).awaitTermination()
    got = spark.read.parquet(out).orderBy("cleaned_text").collect()
    assert [(r.cleaned_text, r.rating, r.batch) for r in got] == [
        ("the first long text", 1, 0), ("the second long text", 5, 0), ("the third long text", 2, 1)]
    counts = spark.read.json(f"{out}.counts").groupBy("batch").agg(
        *[F.sum(c).alias(c) for c in ("raw_rows", "dropped_short", "dropped_duplicates", "kept_rows")]).orderBy("batch")
    assert [tuple(r) for r in counts.collect()] == [(0, 5, 1, 2, 2), (1, 3, 0, 2, 1)]


def test_bounded_stream_state(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(50).select(F.lit("one long enough text").alias("text"), F.lit("u").alias("user_id")).write.json(source)
    cleaned = stream.clean_stream(stream.read_review_stream(spark, source), event_time="ingested_at", delay="1 day")
    stream.write_stream(cleaned, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_job_end_to_end(spark, folder, tmp_path):
    from textrep.plans.job import run
    from textrep.workload.tables import raw_reviews

    raw = tmp_path / "raw"
    raw.mkdir()
    for lang in ("en", "fr"):
        rows = raw_reviews(spark, folder).filter(F.col("category") == lang).select("rating", "text", "user_id").toPandas()
        rows.to_json(raw / f"amazon_reviews_{lang}_sample_{len(rows)}.jsonl", orient="records", lines=True, force_ascii=False)
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "hashing.log").write_text("\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.50\n")
    options = {"encoders": ["tfidf", "hashing"], "size": 8, "max_features": 200}
    out = str(tmp_path / "out")
    table = run(spark, str(raw), out, **options, logs=str(logs)).orderBy("encoder").collect()
    assert [r.encoder for r in table] == ["HASHING", "TFIDF"] and table[0].dim == 64 and table[1].dim == 8
    assert all(v is not None for k, v in table[1].asDict().items())
    totals = spark.read.json(f"{out}/cleaned.summary/totals").first()
    assert totals.raw_rows == totals.kept_rows + totals.dropped_short + totals.dropped_duplicates
    run(spark, str(raw), out, stages=("embeddings",), **options)
    from textrep.plans.encode import read_run_summary

    run(spark, str(raw), out, stages=("embeddings",), encoders=["lost"], word_vectors={"lost": str(tmp_path / "no")})
    rows = {r.encoder: r for r in read_run_summary(spark, f"{out}/embeddings").collect()}
    assert rows.pop("lost").skipped
    assert all(r.reused and r.elapsed for r in rows.values())


def test_tasks_need_no_installed_package(tmp_path):
    """The entry file is loaded from another folder, as a driver program does."""
    code = (
        "import importlib.util as u\n"
        "s = u.spec_from_file_location('e', '/root/repo/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', m.entry(spark).count())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 1" in done.stdout, done.stderr[-2000:]


def test_alignment_is_checked(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, a string")
    right = spark.createDataFrame([(2, "x"), (1, "y")], "row_id long, b string")
    assert sorted(map(tuple, report.align(left, right).collect())) == [(1, "a", "y"), (2, "b", "x")]
    for other in (right.limit(1), right.union(right), right.limit(0)):
        with pytest.raises(ValueError):
            report.align(left, other)


def test_glove_leaves_no_shuffle_of_a_half_sweep(spark, letters):
    """Every half sweep left its vectors, once for each part, in shuffle files until the driver's garbage was collected."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = blocks.getAllFiles()
        return sum(spark._jvm.java.io.File(files.apply(i).getPath()).length() for i in range(files.size()) if "shuffle_" in files.apply(i).getName())

    top, cells = letters
    cells.count()
    before = held()
    assert len(glove.train(cells, 14, size=200, epochs=2, tolerance=-1, parts=8).losses) == 2
    assert held() - before < 300_000

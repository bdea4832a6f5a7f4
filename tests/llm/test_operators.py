"""Every operator against a plain version on rows with nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import math
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textrep.llm import decontaminate, embeddings, gru, language, minhash, personal, pieces, quality, scoring, substrings, urls

SCHEMA = "doc_id long, text string, lang string, kept string, score double"
LONG = " ".join(f"w{i % 7919}" for i in range(20000))
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, BASE), (1, BASE), (2, None), (3, ""), (4, "  \n "), (5, BASE + " end"), (6, BASE.replace("word30", "other")), (7, "a b"), (8, "A B"),
    (9, LONG), (10, LONG + " tail"), (None, BASE), (11, "unrelated " + " ".join(f"q{i}" for i in range(40))), (12, "x" * 70000),
    (13, "start " + " ".join(f"word{i}" for i in range(20, 40)) + " stop"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "k", 0.5) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_minhash(docs, nothing):
    sets = {}
    for i, t in TEXTS:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets if i}
    for _ in root:
        for a in root:
            for b in root:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    root[a] = root[b] = min(root[a], root[b])
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(nothing).count() == 0


def test_substrings(docs, nothing):
    index = {}
    for i, t in TEXTS:
        w = words(t)
        for k in range(len(w) - 12):
            if i:
                key = tuple(w[k : k + 13])
                index[key] = min(index.get(key, i), i)
    got = substrings.remove_repeats(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        text = dict(TEXTS)[r.doc_id]
        w = words(text)
        gone = set()
        for k in range(len(w) - 12):
            if r.doc_id and index[tuple(w[k : k + 13])] < r.doc_id:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), r.doc_id
    assert substrings.remove_repeats(nothing).count() == 0


def test_substrings_beyond_the_broadcast_bounds(docs, monkeypatch):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", "copy_of"]
    want = sorted(map(str, substrings.remove_repeats(docs).select(columns).collect()))
    monkeypatch.setattr(substrings, "MOST_ID_BYTES", 0)
    monkeypatch.setattr(substrings, "MOST_MARK_BYTES", 0)
    assert sorted(map(str, substrings.remove_repeats(docs).select(columns).collect())) == want


def test_decontaminate(spark, docs, nothing):
    items = [("b", " ".join(f"word{i}" for i in range(25, 37))), ("a", "A, b!"), (None, "q3 q4"), ("c", None), ("d", ""), ("b", "nowhere here")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    for block in (1 << 20, 20):
        found = decontaminate.find_benchmark(docs, bench, "found", block_bytes=block)
        got = found.select("doc_id", "text", *decontaminate.hit_columns("found")).collect()
        assert len(got) == len(TEXTS)
        for r in got:
            w, hit, names = cut(r.text), set(), set()
            for name, text in items:
                item = cut(text)
                n = min(len(item), 10)
                for k in range(len(item) - n + 1 if n else 0):
                    for at in range(len(w) - n + 1):
                        if w[at : at + n] == item[k : k + n]:
                            hit.update(range(at, at + n))
                            names.add(name or "")
            digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(names), digest, bool(hit))
    assert decontaminate.find_benchmark(nothing, bench.limit(0), "found").count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL = [
    "a@b.c_d@e.f x@y@z.w", "+1 +12345678 -+49 (30) 1234-5678 9.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.001", None, "", "9" * 5000, "a" * 60000,
    "4111 1111 1111 1111, 4111-1111-1111-1111-0", "é@b.co ünï 10.0.0.1é", "+1" * 3000, "12.34.56.78@a.b", "a.b@c-.d-..e", "+123456789", "+12 3456789 1 2 3 4 5 6 7 8",
]


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def test_personal(spark):
    df = spark.createDataFrame(list(enumerate(PERSONAL)), "doc_id long, text string")
    for r in personal.find_personal(df, "found").select("doc_id", *personal.span_columns("found")).collect():
        want = []
        for kind, pattern in PLAIN.items():
            for m in re.finditer(pattern, PERSONAL[r.doc_id] or ""):
                digits = re.sub("[^0-9]", "", m[0])
                right = {"email": True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}.get(kind)
                if right or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")):
                    want.append(f"{kind}:{m.start()}:{m.end()}")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), r
    bank = spark.createDataFrame([(1, "DE89 3704 0044 0532 0130 00, DE88370400440532013000 my ssn 123-45-6789")], "doc_id long, text string")
    row = personal.find_personal(bank, "found").select(F.expr("transform(found, s -> s.kind)").alias("k"), personal.mask(F.col("text"), F.col("found")).alias("m")).first()
    assert row.k == ["iban", "ssn"] and row.m == "[IBAN], DE88370400440532013000 my ssn [SSN]"


def test_bank_accounts_end_at_the_length_of_their_country(spark):
    plain, four, british = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    cases = [
        (f"pay {plain} Please confirm", [plain]), (f"{british} Thanks", [british]), (f"IBAN {four} BIC COBADEFFXXX.", [four]),
        (f"{plain} 2024", [plain]), (f"é\U0001f600 {four} {british} NO9386011117947", [four, british, "NO9386011117947"]),
        (f"AT99 {four} 12", [four]), (f"{plain}x, X{plain}, {plain}0, DE88370400440532013000 A", []), ("MT84MALT011000012345MTLCAST001S", ["MT84MALT011000012345MTLCAST001S"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in personal.find_personal(df, "found").collect():
        text, want = cases[r.doc_id]
        got = [s for s in r.found if s.kind == "iban"]
        assert [s.text for s in got] == want and [text[s.start : s.end] for s in got] == want, r


def test_context_goes_past_other_matches_and_behind_the_span(spark):
    far = "\U0001f600x " * 200
    cases = [
        ("SSN 111-22-3333, 222-33-4444", ["111-22-3333", "222-33-4444"]), ("111-22-3333 (SSN)", ["111-22-3333"]), ("111-22-3333 and 222-33-4444", []),
        (f"ssn {far} 111-22-3333 {far} ssn", []), (f"{far} 111-22-3333 (ssn) {far}", ["111-22-3333"]), (f"{far[:757]} ssn 111-22-3333", ["111-22-3333"]),
        ("serial 111-22-3333, ssn 222-33-4444", ["222-33-4444"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in personal.find_personal(df, "found").collect():
        text, want = cases[r.doc_id]
        assert [text[s.start : s.end] for s in r.found if s.kind == "ssn"] == want, r


def test_pieces(docs, nothing):
    hard = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(20, "é▁x 日本 \U0001f600\n\t  end  "), (21, "a" * 3000)], "doc_id long, text string"))
    got = pieces.round_trip(hard).collect()
    assert len(got) == len(TEXTS) + 2 and all(r.lossless for r in got)
    again = {r.doc_id: r.pieces_sha256 for r in pieces.round_trip(hard.repartition(5)).collect()}
    assert all(again[r.doc_id] == r.pieces_sha256 for r in got)
    assert pieces.round_trip(nothing).count() == 0


def test_piece_draws_follow_the_lattice():
    vocabulary = pieces.load(sharpness=0.5)
    ids = {p: int(i) for i, p in zip(vocabulary.ids, (vocabulary.pieces[i] for i in vocabulary.ids))}

    def paths(text):
        if not text:
            yield (), 0.0
        for n in range(1, len(text) + 1):
            if text[:n] in ids:
                for rest, weight in paths(text[n:]):
                    yield (ids[text[:n]], *rest), weight + vocabulary.weight[ids[text[:n]]]

    every = dict(paths(b" there"))
    total = sum(math.exp(w) for w in every.values())
    draws = pieces.sample(pa.array([" there"] * 20000), np.random.default_rng(1).integers(0, 1 << 63, 20000).astype(np.uint64), vocabulary)
    seen = Counter(tuple(x) for x in draws.to_pylist())
    assert set(seen) <= set(every)
    for path, weight in every.items():
        share = math.exp(weight) / total
        assert abs(seen[path] / 20000 - share) < 5 * math.sqrt(share / 20000) + 1e-4


def test_language(spark, docs, nothing):
    learned = spark.createDataFrame([(i, t, g, "k", 0.5) for i in range(40) for t, g in (("the thing of that", "en"), ("der die das und", "de"))], SCHEMA)
    filters = language.learn(learned)
    rows = [("the that", "en"), ("UND DAS", "de"), (None, "und"), ("", "und"), ("12 !?", "und")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert all(r.found.lang == r.lang and 0 <= r.found.score <= 1 for r in language.language(df, filters, "found").collect())
    empty = language.learn(nothing)
    assert {r.found.lang for r in language.language(docs, empty, "found").collect()} == {"und"}
    assert language.language(nothing, filters, "found").count() == 0


def test_urls(spark):
    made = ["http://a.net/x", "http://net/", "http://net", "HTTPS://B.Example.NET/en/1?q", "x://example.net/en", "http://example.com/de/#a", "http://m.org/fr/", "http://org/frx/", None, "", "nothing", "a://b://c.net/", "http://badnet/"]
    df = spark.createDataFrame(list(enumerate(made)), "page_id long, url string")
    for r in urls.judge(df).collect():
        fits = [x for x in urls.RULES if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.host), len(x.path)), default=None)
        assert (r.rule, r.verdict) == ((best.name, best.verdict) if best else (None, "allow")), r
    assert sorted(map(str, urls.judge(df).collect())) == sorted(map(str, urls.judge(df, most_bytes=0).collect()))
    assert urls.judge(df.limit(0)).count() == 0


def test_quality(spark, docs, nothing):
    rows = [(i, f"fine words here {i % 7}" if i % 3 else f"bad ### noise {i % 5} ###", int(i % 3 > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.learn(df)
    got = quality.quality(df, model, "found").collect()
    assert sum((r.found.score >= 0.3) == r.label for r in got) > 290
    blank = [r.found.score for r in quality.quality(docs, model, "found").where("text is null or text = ''").collect()]
    assert len(blank) == 2 and blank[0] == blank[1] and 0 <= blank[0] <= 1
    none = quality.learn(df.limit(0))
    assert {r.found.score for r in quality.quality(docs, none, "found").collect()} == {0.5}
    assert quality.quality(nothing, model, "found").count() == 0


def test_scores(spark, docs, nothing):
    train = docs.where(F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    got = scoring.score_documents(docs, train).collect()
    counts = Counter()
    for i, t in TEXTS:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(TEXTS)
    for r in got:
        tokens = [*words(low(dict(TEXTS)[r.doc_id])), None]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0
    assert scoring.score_documents(docs, nothing).count() == len(TEXTS)


def test_recurrent_gradients_and_score():
    random = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in gru.initial(np.ones(gru.SIZE)).items()}
    target = random.integers(0, gru.SIZE, 50)
    states = random.normal(size=(50, gru.STATE))
    grads = {k: np.zeros_like(x) for k, x in p.items()}
    back = gru.output(p, states, target, grads)[1]
    moved = states.copy()
    moved[3, 2] += 1e-6
    assert math.isclose(-(gru.output(p, moved, target)[0].sum() - gru.output(p, states, target)[0].sum()) / 1e-6, back[3, 2], abs_tol=1e-5)
    every = [gru.output(p, states[:1], np.array([t]))[0][0] for t in range(gru.SIZE)]
    assert math.isclose(np.exp(every).sum(), 1.0, rel_tol=1e-9)
    model = gru.initial(np.ones(gru.SIZE))
    text = random.integers(2, 6, 400)
    trained = gru.train({k: x.copy() for k, x in model.items()}, [text] * 50, lanes=8)
    assert gru.score(trained, [text])[0] > gru.score(model, [text])[0] + 100
    both = gru.score(trained, [text[:7], text, text[:1]])
    assert np.allclose(both, [gru.score(trained, [t])[0] for t in (text[:7], text, text[:1])], atol=1e-3)


def test_language_model_knows_most_tokens_of_a_large_vocabulary(spark):
    random = np.random.default_rng(1)
    lines = [" ".join(f"w{x}" for x in random.integers(0, 3000, 4) for _ in range(25)) for _ in range(800)]
    held = " ".join(f"w{x}" for x in (2001, 2002, 2003, 2004) for _ in range(25))
    shuffled = " ".join(random.permutation(held.split()))
    assert [scoring.vocabulary_size(n) for n in (0, 3000, 10**6)] == [gru.SIZE, 3002, scoring.TOKENS]
    train = spark.createDataFrame(list(enumerate(lines * 4)), "doc_id long, text string").repartition(2)
    docs = spark.createDataFrame([(1, held), (2, shuffled)], "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.score_documents(docs, train).collect()}
    assert math.isclose(got[1].base_score, got[2].base_score) and got[1].score > got[2].score + 5


def test_long_texts_and_rare_choices_of_the_model():
    """A step of a long text counted all tokens held before it; odds below the range of the numbers."""
    model = gru.initial(np.ones(gru.SIZE))
    tokens = np.random.default_rng(0).integers(0, gru.SIZE, 30000)
    times = []
    for n in (7500, 30000):
        begin = time.process_time()
        gru.score(model, [tokens[:n]])
        times.append(time.process_time() - begin)
    assert times[1] < 8 * times[0]
    texts = [tokens[i : i + 1 + i % 3] for i in range(gru.SCORED + 5)]
    some = [0, 7, gru.SCORED - 1, gru.SCORED + 4]
    assert np.allclose(gru.score(model, texts)[some], [gru.score(model, [texts[i]])[0] for i in some], atol=1e-3)
    model["cb"][0], model["wb"][1] = -200, -200
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    found, back = gru.output(model, np.ones((3, gru.STATE), np.float32), np.array([1, 100, 0]), grads)
    assert found[0] < -390 and -250 < found[2] < -190 and -20 < found[1]
    assert np.isfinite(back).all() and all(np.isfinite(g).all() for g in grads.values())
    assert math.isclose(grads["cb"][0], -2, abs_tol=1e-3)  # two of three chose the first class


def test_large_logits_and_lookup_of_words():
    """Sums beyond the range of the numbers; training tasks held the counts of all frequent words."""
    model = gru.initial(np.ones(gru.SIZE))
    states = np.ones((3, gru.STATE), np.float32)
    target = np.array([0, 100, 500])
    plain = gru.output(model, states, target)[0]
    raised = model | {"cb": model["cb"] + 500, "wb": model["wb"] - 500}
    assert np.allclose(gru.output(raised, states, target)[0], plain, atol=1e-3)
    random = np.random.default_rng(0)
    hashes = random.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)
    lexicon = scoring.Lexicon(np.append(hashes, scoring.END), np.arange(5001, 0, -1))
    assert len(lexicon.tokens_only().words) == gru.SIZE - 1
    for known in (lexicon, lexicon.tokens_only(), scoring.Lexicon(hashes[:0], np.zeros(0, np.int64))):
        asked = np.concatenate([hashes, hashes + np.uint64(1), [scoring.END]])
        at, there = known.find(asked)
        assert (there == np.isin(asked, known.words)).all() and (known.words[at[there]] == asked[there]).all()


def test_a_rare_end_is_a_known_token(spark, monkeypatch):
    """Where other words filled the list of counts that are sent, the end was taken for unknown."""
    monkeypatch.setattr(scoring, "MOST_SENT", 2)
    docs = spark.createDataFrame([(1, "a a a a b b b b c"), (2, "c d"), (2, "c d")], "doc_id long, text string")
    got = {r.doc_id: r for r in scoring.score_documents(docs, docs.where("doc_id = 1")).collect()}
    assert (got[1].n_known, got[1].n_tokens, got[2].n_known, got[2].n_tokens) == (10, 10, 2, 3)
    assert math.isclose(got[2].base_score, math.log10(2 / 15) * 2 + math.log10(1 / 15))


def test_embeddings(spark):
    random = np.random.default_rng(3)
    base = random.normal(size=(300, 16))
    rows = [*base.tolist(), *(base[:60] + random.normal(size=(60, 16)) * 0.15).tolist(), *base[:5].tolist(), base[0].tolist(), (base[1] * 3).tolist()]
    odd = [None, [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16]
    df = spark.createDataFrame(list(enumerate([*rows, *odd])), "vec_id long, embedding array<double>")
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95 - 1e-12
    np.fill_diagonal(link, False)
    root = np.arange(len(rows))
    for _ in rows:
        root = np.minimum(root, np.where(link, root[None, :], len(rows)).min(axis=1))
    for cut in (1024, 20):
        for r in embeddings.near_duplicates(df, leaf=32, block=cut).collect():
            want = (int(link[r.vec_id].sum()), int(root[r.vec_id])) if r.vec_id < len(rows) else (0, r.vec_id)
            assert (r.n_links, r.component_id, r.kept) == (*want, want[1] == r.vec_id)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_several_widths(spark):
    rows = [(i, [1.0, 2.0 + i / 100]) for i in range(4)] + [(10 + i, [float(i == j) for j in range(5)]) for i in range(3)] + [(20, [1.0, 0.0, 0.0, 0.0, 0.01]), (30, [1.0, 2.0, 3.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 10: (1, 10), 11: (0, 11), 12: (0, 12), 20: (1, 10), 30: (0, 30)}


@pytest.mark.parametrize("room, most", [(60, 1500), (16, 1 << 18)])
def test_embeddings_in_branches_and_rounds(spark, monkeypatch, room, most):
    """Each vector was shuffled once for every leaf, and its shuffle files stayed."""
    monkeypatch.setattr(embeddings, "ROUND", most)
    random = np.random.default_rng(4)
    base = random.normal(size=(200, 8))
    rows = np.concatenate([base, base[:40] + random.normal(size=(40, 8)) * 0.1, base[0] + random.normal(size=(90, 8)) * 0.05, -base[:1] * 0]).astype(np.float32)
    rows[3, 2], rows[7] = 0.0, rows[3]
    rows[7, 2] = -0.0
    df = spark.createDataFrame([(i if i != 5 else None, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    ids = np.array([i for i in range(len(rows) - 1) if i != 5])
    unit = rows[ids].astype(float) / np.linalg.norm(rows[ids].astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    root = ids
    for _ in ids:
        root = np.minimum(root, np.where(link, root[None, :], len(rows)).min(axis=1))
    want = {i: (n, r, i == r) for i, n, r in zip(ids.tolist(), link.sum(axis=1).tolist(), root.tolist())} | {330: (0, 330, True), None: (0, None, True)}
    found = embeddings.near_duplicates(df, leaf=24, block=10, room=room)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()} == want


def test_branches_hold_every_node_with_pairs():
    """A branch has ``room`` vectors at most; a leaf above that is cut into pairs of blocks."""
    tree = embeddings.Tree(np.zeros((2, 1)), np.array([0, 1, 1, 2, 2]), np.zeros(5), np.array([1, 3, -1, -1, -1]))
    found = embeddings.branches([tree], [np.array([100, 50, 70, 1, 49])], 50)
    assert [(b.node, b.parts, b.low, b.high) for b in found] == [(1, 1, 0, 0)] + [(2, 3, a, b) for a in range(3) for b in range(a, 3)]
    assert [b.node for b in embeddings.branches([tree], [np.array([100, 50, 70, 1, 49])], 49)][0] == 4
    assert sum(embeddings.in_rounds(found, 60), []) == found and all(sum(b.rows for b in r) <= 100 for r in embeddings.in_rounds(found, 60))


def test_shuffle_files_go_with_what_they_made(spark):
    from textrep.session import FREE_CONF, cut_lineage

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    def held():
        files = blocks.getAllFiles()
        return {files.apply(i).getPath() for i in range(files.size()) if "shuffle_" in files.apply(i).getName()}
    def left(free):
        before = held()
        assert cut_lineage(spark.range(100_000).repartition(3, "id"), "rows", free=free).count() == 100_000
        return [p for p in held() - before if spark._jvm.java.io.File(p).length() > 10_000]

    assert left(False) and not left(True) and spark.conf.get(FREE_CONF, "false") == "false"


def test_stages_send_few_texts_at_once(spark, folder):
    """Batches of 10,000 whole texts filled an executor's memory."""
    before = spark.conf.get(corpus_pipeline.BATCH)

    def most(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows = spark.range(0, 2000, 1, 1)
    try:
        docs = spark.createDataFrame([(1, "a text of words", "en")], "doc_id long, text string, lang string")
        for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.decontamination, corpus_pipeline.encoding):
            spark.conf.set(corpus_pipeline.BATCH, "10000")
            stage(spark, docs, folder)
            assert max(r.n for r in rows.mapInArrow(most, "n long").collect()) <= 500
        spark.conf.set(corpus_pipeline.BATCH, "7")
        corpus_pipeline.encoding(spark, docs, folder)
        assert spark.conf.get(corpus_pipeline.BATCH) == "7"
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)


def test_near_dedup_stage_keeps_texts_that_share_an_id(spark, folder):
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"]
    other = " ".join(f"other{i}" for i in range(30))
    rows = [(1, BASE), (5, BASE + " end"), (5, other), (7, other + " more"), (None, BASE), (None, BASE), (8, ""), (8, ""), (9, None), (9, None), (10, "")]
    df = spark.createDataFrame([(i, t, "en", "k", 0.5) for i, t in rows], SCHEMA)
    got = stage(spark, df, folder)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, BASE), (5, other), (None, BASE), (None, BASE), (8, ""), (9, None), (10, "")])
    assert stage(spark, df.limit(0), folder).count() == 0


def test_tasks_need_no_installed_package(tmp_path):
    """Every query runs where only the driver can import the package."""
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = (
        "import importlib.util as u, sys\n"
        f"s = u.spec_from_file_location('e', {repo + '/__spark_entry__.py'!r}); m = u.module_from_spec(s); s.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "names = [n for n in m.queries() if n.startswith('op') and n[2].isdigit()] + ['pipeline']\n"
        "for n in names: print(n, m.queries()[n](spark, '/root/testdata/sf0.001').count(), flush=True)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert len(done.stdout.splitlines()) == 14, done.stderr[-3000:]


def test_pipeline_stages(spark, docs, folder):
    bench = dict((name, f) for name, f in corpus_pipeline.STAGES)
    clean = docs.where("doc_id <> 12 OR doc_id IS NULL")
    rows = bench["MinHash near-dedup"](spark, clean, folder)
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == Counter([1, 2, 3, 4, 7, 9, None, 11, 13])
    masked = bench["PII"](spark, spark.createDataFrame([(1, "to a@b.co now", "en", "k", 0.5), (2, None, "en", "k", 0.5)], SCHEMA), folder)
    assert sorted((r.doc_id, r.text) for r in masked.collect()) == [(1, "to [EMAIL] now"), (2, None)]
    coded = bench["SentencePiece"](spark, docs, folder)
    assert coded.columns == [*docs.columns, "pieces"] and coded.count() == len(TEXTS)

"""Queries over vectors, labels and score columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from textrep.functions.vectors import normalized
from textrep.operators import classification, clustermetrics, histogram, knn, retrieval, select
from textrep.operators.vocab import label_codes
from textrep.sources.reviews import label_column
from textrep.workload.tables import VECTORS_SQL, table, vectors

QUERIES, ORACLE = {}, {}
# The stated queries of a search; all rows are searched.
QUERY_ROWS = "row_id % 20 = 0"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


@query(f"""WITH {VECTORS_SQL}, n AS (SELECT row_id, unnest(embedding) AS x, sqrt(list_sum([x * x FOR x IN embedding])) AS len,
generate_subscripts(embedding, 1) - 1 AS pos FROM vec) SELECT row_id, CAST(pos AS INTEGER) AS pos, round(x / len, 6) AS x FROM n""")
def normalized_vectors(spark, folder):
    unit = vectors(spark, folder).select("row_id", F.posexplode(normalized(F.col("embedding"))).alias("pos", "x"))
    return unit.withColumn("x", F.round("x", 6))


# Every row asks for its nearest others.
_L2 = f"""{VECTORS_SQL},
pairs AS (SELECT q.row_id AS query_id, b.row_id, list_sum([(q.embedding[i] - b.embedding[i]) * (q.embedding[i] - b.embedding[i])
          FOR i IN range(1, len(q.embedding) + 1)]) AS score FROM vec q JOIN vec b ON q.row_id <> b.row_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, row_id) AS rank FROM pairs)"""


@query(f"WITH {_L2} SELECT query_id, row_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits WHERE rank <= 10 AND query_id % 20 = 0")
def knn_l2(spark, folder):
    base = vectors(spark, folder)
    return knn.nearest(base.filter(QUERY_ROWS), base, 10).withColumn("score", F.round("score", 6))


@query(f"""WITH {VECTORS_SQL}, unit AS (SELECT row_id, embedding, sqrt(list_sum([x * x FOR x IN embedding])) AS len FROM vec),
pairs AS (SELECT q.row_id AS query_id, b.row_id, list_sum([q.embedding[i] / q.len * (b.embedding[i] / b.len)
          FOR i IN range(1, len(q.embedding) + 1)]) AS score FROM unit q JOIN unit b ON q.row_id <> b.row_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM pairs)
SELECT query_id, row_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits WHERE rank <= 10 AND query_id % 20 = 0""")
def knn_cosine(spark, folder):
    base = vectors(spark, folder)
    return knn.nearest(base.filter(QUERY_ROWS), base, 10, "cosine").withColumn("score", F.round("score", 6))


_MATCHED = f"""{_L2},
matched AS (SELECT h.query_id, rank, q.label = r.label AS match FROM hits h JOIN vec q ON h.query_id = q.row_id
            JOIN vec r ON h.row_id = r.row_id WHERE rank <= 50),
per_query AS (SELECT query_id, avg(match::INT) FILTER (rank <= 5) AS p5, avg(match::INT) FILTER (rank <= 10) AS p10,
              avg(match::INT) AS p50, coalesce(1.0 / min(rank) FILTER (match), 0) AS rr FROM matched GROUP BY query_id)"""


@query(f"""WITH {_MATCHED} SELECT round(avg(rr), 6) AS mrr, round(avg(p5), 6) AS precision_5, round(avg(p10), 6) AS precision_10,
round(avg(p50), 6) AS precision_50, count(*) AS query_sample_size FROM per_query""")
def retrieval_quality(spark, folder):
    found = retrieval.evaluate_retrieval(vectors(spark, folder), "label")
    names = ("mrr", "precision_5", "precision_10", "precision_50")
    return found.select(*[F.round(c, 6).alias(c) for c in names], "query_sample_size")


@query(f"""WITH {_MATCHED} SELECT query_id, round(p5, 6) AS precision_5, round(p10, 6) AS precision_10,
round(p50, 6) AS precision_50, round(rr, 6) AS reciprocal_rank FROM per_query WHERE query_id % 20 = 0""")
def retrieval_per_query(spark, folder):
    """Self matches removed by the rank-0 rule, which agrees when no copy outranks the query."""
    base = vectors(spark, folder)
    hits = knn.nearest(base.filter(QUERY_ROWS), base, 50, self_policy="rank0")
    scores = retrieval.per_query(retrieval.matches(hits, base, "label"))
    return scores.select("query_id", *[F.round(c, 6).alias(c) for c in scores.columns if c != "query_id"])


@query(f"WITH {VECTORS_SQL} SELECT label, cluster, count(*) AS n FROM vec GROUP BY 1, 2")
def contingency(spark, folder):
    return clustermetrics.contingency(vectors(spark, folder))


_CELLS = f"""{VECTORS_SQL}, cell AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM vec GROUP BY 1, 2),
a AS (SELECT label, sum(n) AS n FROM cell GROUP BY 1), b AS (SELECT cluster, sum(n) AS n FROM cell GROUP BY 1), t AS (SELECT sum(n) AS n FROM cell)"""


@query(f"""WITH {_CELLS},
mi AS (SELECT sum(cell.n / t.n * ln(cell.n * t.n / (a.n * b.n))) AS v FROM cell JOIN a USING (label) JOIN b USING (cluster), t),
ha AS (SELECT -sum(a.n / t.n * ln(a.n / t.n)) AS v FROM a, t), hb AS (SELECT -sum(b.n / t.n * ln(b.n / t.n)) AS v FROM b, t)
SELECT round(mi.v / ((ha.v + hb.v) / 2), 6) AS nmi FROM mi, ha, hb""")
def nmi(spark, folder):
    return clustermetrics.nmi(clustermetrics.contingency(vectors(spark, folder))).withColumn("nmi", F.round("nmi", 6))


@query(f"""WITH {_CELLS},
c AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cell) AS both_same, (SELECT sum(n * (n - 1) / 2) FROM a) AS same_a,
      (SELECT sum(n * (n - 1) / 2) FROM b) AS same_b, (SELECT n * (n - 1) / 2 FROM t) AS everything)
SELECT round((both_same - same_a * same_b / everything) / ((same_a + same_b) / 2 - same_a * same_b / everything), 6) AS ari FROM c""")
def ari(spark, folder):
    return clustermetrics.ari(clustermetrics.contingency(vectors(spark, folder))).withColumn("ari", F.round("ari", 6))


@query(f"""WITH {VECTORS_SQL},
pairs AS (SELECT q.row_id, q.cluster AS own, b.cluster AS other, sqrt(list_sum([(q.embedding[i] - b.embedding[i]) *
 (q.embedding[i] - b.embedding[i]) FOR i IN range(1, len(q.embedding) + 1)])) AS d FROM vec q JOIN vec b ON q.row_id <> b.row_id),
means AS (SELECT row_id, own, other, avg(d) AS m FROM pairs GROUP BY 1, 2, 3),
ab AS (SELECT row_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM means GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS sample_size FROM ab""")
def silhouette(spark, folder):
    return clustermetrics.silhouette(vectors(spark, folder)).withColumn("silhouette", F.round("silhouette", 6))


@query(f"""WITH {VECTORS_SQL},
pairs AS (SELECT q.row_id, q.cluster AS own, b.cluster AS other, list_sum([(q.embedding[i] - b.embedding[i]) *
 (q.embedding[i] - b.embedding[i]) FOR i IN range(1, len(q.embedding) + 1)]) AS d FROM vec q JOIN vec b ON q.row_id <> b.row_id),
means AS (SELECT row_id, own, other, avg(d) AS m FROM pairs GROUP BY 1, 2, 3),
ab AS (SELECT row_id, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM means GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS sample_size FROM ab""")
def silhouette_all(spark, folder):
    """All rows, by squared distances."""
    return clustermetrics.silhouette_of_all(vectors(spark, folder)).withColumn("silhouette", F.round("silhouette", 6))


@query(f"WITH {VECTORS_SQL} SELECT rating AS label, cluster, count(*) AS n FROM vec GROUP BY 1, 2")
def label_fallback(spark, folder):
    """The rating is the label of vectors without a category."""
    rows = vectors(spark, folder)
    return clustermetrics.contingency(rows, label_column(rows, "category"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
WHERE l_extendedprice <= (SELECT quantile_cont(l_extendedprice, 0.01) FROM lineitem)""")
def quantile_flags(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    flagged, _ = select.flag_low(rows, "l_extendedprice", 0.01)
    return flagged.filter("flagged").drop("flagged")


@query("""SELECT event_id, value FROM events WHERE value >= (SELECT min(value) FROM
(SELECT value FROM events WHERE value IS NOT NULL ORDER BY value DESC LIMIT
 (SELECT greatest(1, CAST(floor(count(value) * 0.01) AS BIGINT)) FROM events)))""")
def topn_flags(spark, folder):
    flagged, _ = select.flag_high(table(spark, folder, "events").select("event_id", "value"), "value", 0.01)
    return flagged.filter("flagged").drop("flagged")


_HIST = """r AS (SELECT event_type, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 80 AS step FROM events GROUP BY 1),
g AS (SELECT events.event_type, value, lo, hi, step, least(CAST(floor((value - lo) * (80.0::DOUBLE / (hi - lo))) AS INTEGER), 79) AS g
      FROM events JOIN r USING (event_type) WHERE value IS NOT NULL),
p AS (SELECT event_type, g - CASE WHEN value < lo + g * step THEN 1 ELSE 0 END
      + CASE WHEN value >= CASE WHEN g = 79 THEN hi ELSE lo + (g + 1) * step END AND g < 79 THEN 1 ELSE 0 END AS bin FROM g),
c AS (SELECT event_type, bin, count(*) AS n FROM p GROUP BY 1, 2),
h AS (SELECT r.event_type, CAST(i AS INTEGER) AS bin, lo + (i + 0.5::DOUBLE) * step AS centre, step AS width,
      coalesce(n, 0) AS n FROM r CROSS JOIN range(80) t(i) LEFT JOIN c ON c.event_type = r.event_type AND c.bin = i)"""


@query(f"WITH {_HIST} SELECT event_type, bin, round(centre, 9) AS centre, round(width, 9) AS width, n FROM h")
def histogram80(spark, folder):
    found = histogram.histogram(table(spark, folder, "events"), "value", by=("event_type",))
    return found.withColumn("centre", F.round("centre", 9)).withColumn("width", F.round("width", 9))


_KERNEL = ", ".join(f"({o}, exp(-0.5 * ({o} / 1.25) * ({o} / 1.25)))" for o in range(-5, 6))


@query(f"""WITH {_HIST}, k(o, w) AS (VALUES {_KERNEL}),
s AS (SELECT a.event_type, a.bin, sum(b.n * k.w) AS s FROM h a JOIN h b ON a.event_type = b.event_type JOIN k ON b.bin - a.bin = k.o GROUP BY 1, 2)
SELECT event_type, bin, round(s / (SELECT sum(w) FROM k), 6) AS smooth FROM s""")
def smoothed_histogram(spark, folder):
    hist = histogram.histogram(table(spark, folder, "events"), "value", by=("event_type",))
    return histogram.smoothed(hist, ("event_type",)).select("event_type", "bin", F.round("smooth", 6).alias("smooth"))


_PRED = """pred AS (SELECT d.doc_id, l.quality + 2 * l.toxic AS truth, CASE WHEN n_chars % 5 < 2 THEN 0 WHEN n_chars % 5 < 3 THEN 1 ELSE 2 END AS pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
cls AS (SELECT DISTINCT c FROM (SELECT truth AS c FROM pred UNION ALL SELECT pred FROM pred)),
cells AS (SELECT t.c AS truth, p.c AS pred, count(x.doc_id) AS n FROM cls t CROSS JOIN cls p LEFT JOIN pred x ON x.truth = t.c AND x.pred = p.c GROUP BY 1, 2)"""


def _predictions(spark, folder):
    """Label pairs as truth, a rule on the text length as prediction."""
    rest = F.pmod("n_chars", F.lit(5))
    guess = F.when(rest < 2, 0).when(rest < 3, 1).otherwise(2)
    docs = table(spark, folder, "documents").select("doc_id", guess.alias("pred"))
    labels = table(spark, folder, "labels").select("doc_id", (F.col("quality") + 2 * F.col("toxic")).alias("truth"))
    return labels.join(docs, "doc_id")


@query(f"WITH {_PRED} SELECT CAST(truth AS INTEGER) AS truth, CAST(pred AS INTEGER) AS pred, n FROM cells")
def confusion(spark, folder):
    return classification.confusion(_predictions(spark, folder))


@query(f"""WITH {_PRED} SELECT 'true_' || truth AS truth, CAST(sum(n) FILTER (pred = 0) AS BIGINT) AS pred_0,
CAST(sum(n) FILTER (pred = 1) AS BIGINT) AS pred_1, CAST(sum(n) FILTER (pred = 2) AS BIGINT) AS pred_2 FROM cells GROUP BY truth""")
def confusion_wide(spark, folder):
    return classification.confusion_wide(classification.confusion(_predictions(spark, folder)), [0, 1, 2])


_F1 = f"""{_PRED}, per AS (SELECT c, (SELECT coalesce(sum(n), 0) FROM cells WHERE truth = c) AS support,
(SELECT coalesce(sum(n), 0) FROM cells WHERE pred = c) AS predicted, (SELECT coalesce(sum(n), 0) FROM cells WHERE truth = c AND pred = c) AS hit FROM cls),
f AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted::DOUBLE ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS r,
CASE WHEN support + predicted > 0 THEN 2 * hit / (support + predicted)::DOUBLE ELSE 0 END AS f1 FROM per)"""


@query(f"""WITH {_F1} SELECT CAST(c AS INTEGER) AS class, CAST(support AS BIGINT) AS support, round(p, 6) AS precision, round(r, 6) AS recall,
round(f1, 6) AS f1 FROM f""")
def class_f1(spark, folder):
    rows = classification.class_scores(classification.confusion(_predictions(spark, folder)))
    return rows.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_F1} SELECT round(sum(hit) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
round(sum(f1 * support) / sum(support)::DOUBLE, 6) AS weighted_f1 FROM f""")
def f1_scores(spark, folder):
    scores = classification.overall_scores(classification.confusion(_predictions(spark, folder)))
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


@query("SELECT doc_id, quality, CAST(dense_rank() OVER (ORDER BY quality) - 1 AS INTEGER) AS code FROM labels WHERE quality IS NOT NULL")
def target_codes(spark, folder):
    return label_codes(table(spark, folder, "labels").filter("quality is not null"), "quality").select("doc_id", "quality", "code")

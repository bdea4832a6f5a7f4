"""Queries that fit a model on the given vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textrep.operators import anomaly, clustering, probe, projection
from textrep.workload.tables import VECTORS_SQL, sql_hash, table, vectors

QUERIES, ORACLE = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def kmeans(spark, folder):
    return clustering.kmeans(vectors(spark, folder), 10, ("row_id", "label"))


@query
def mini_batch_kmeans(spark, folder):
    return clustering.mini_batch_kmeans(vectors(spark, folder), 10, ("row_id", "label"))


def nearest_centres(spark, folder):
    """Every vector with the nearest of ten of them."""
    rows = vectors(spark, folder)
    first = rows.orderBy("row_id").limit(10).collect()
    found = clustering.assign(rows, np.array([r.embedding for r in first]))
    return found.select("row_id", "cluster", F.round("far", 6).alias("far"))


QUERIES["nearest_centres"] = nearest_centres
ORACLE["nearest_centres"] = f"""WITH {VECTORS_SQL}, centres AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS number, embedding AS c FROM (SELECT * FROM vec ORDER BY row_id LIMIT 10)),
far AS (SELECT row_id, number, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(embedding, c)]) AS far FROM vec CROSS JOIN centres)
SELECT row_id, CAST(arg_min(number, far) AS INTEGER) AS cluster, round(min(far), 6) AS far FROM far GROUP BY row_id"""


@query
def clustering_quality(spark, folder):
    return clustering.evaluate_clustering(vectors(spark, folder), "label")[1]


@query
def isolation_forest(spark, folder):
    return anomaly.anomaly_table(vectors(spark, folder), contamination=0.02)[0]


@query
def isolation_outliers(spark, folder):
    return anomaly.outliers(vectors(spark, folder), contamination=0.02)


@query
def rating_regression(spark, folder):
    """The older ridge form."""
    return anomaly.rating_inconsistencies(vectors(spark, folder), 0.02, ridge=anomaly.RIDGE_ALPHA)[0]


@query
def linear_probe(spark, folder):
    return probe.evaluate_probe(vectors(spark, folder), "rating")[0]


@query
def linear_probe_softmax(spark, folder):
    return probe.evaluate_probe(vectors(spark, folder), "rating", multinomial=True)[1]


@query
def reduced_vectors(spark, folder):
    return projection.reduce_dimensions(vectors(spark, folder))


@query
def projection_2d(spark, folder):
    base = vectors(spark, folder)
    return projection.comparison(base, "label", base.select("row_id", "cluster"))


@query
def projection_limits(spark, folder):
    return projection.axis_limits(projection.comparison(vectors(spark, folder), "label"))


def checked(sql: str):
    """A query whose result SQL can state although it cannot fit the model."""

    def add(function):
        ORACLE[function.__name__] = sql
        return query(function)

    return add


@checked("SELECT count(*) AS rows, 10::BIGINT AS clusters FROM embeddings")
def kmeans_sizes(spark, folder):
    rows = clustering.kmeans(vectors(spark, folder), 10, ("row_id",))
    return rows.agg(F.count_distinct("row_id").alias("rows"), F.count_distinct("cluster").alias("clusters"))


@checked("""SELECT count(*) AS rows, CAST(floor(0.02 * (count(*) - 1)) + 1 AS BIGINT) AS iso_anomaly_count,
CAST(greatest(1, floor(count(*) * 0.02)) AS BIGINT) AS inconsistency_count FROM embeddings""")
def anomaly_counts(spark, folder):
    """Flag counts follow from the share alone when no scores tie at the threshold."""
    rows, _ = anomaly.anomaly_table(vectors(spark, folder), contamination=0.02)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("iso_anomaly").alias("iso_anomaly_count"),
        F.count_if("inconsistent").alias("inconsistency_count"))


def _quota_sql(label: str, size: str) -> str:
    return f"""counts AS (SELECT {label} AS label, count(*) AS n FROM vec GROUP BY 1), total AS (SELECT sum(n) AS n FROM counts),
share AS (SELECT label, counts.n / total.n::DOUBLE * {size} AS share FROM counts, total),
quota AS (SELECT label, CAST(floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label DESC)
  <= {size} - (SELECT sum(floor(share)) FROM share) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM share)"""


@checked(f"""WITH {VECTORS_SQL}, {_quota_sql("CAST(label AS VARCHAR)", "(SELECT least(50000, n) FROM total)")}
SELECT row_id, label, cluster FROM (SELECT row_id, CAST(vec.label AS VARCHAR) AS label, cluster, quota, row_number() OVER
(PARTITION BY vec.label ORDER BY {sql_hash('row_id')}, row_id) AS r FROM vec JOIN quota ON CAST(vec.label AS VARCHAR) = quota.label)
WHERE r <= quota""")
def projection_sample(spark, folder):
    """The rows of the two-dimensional comparison with their labels and clusters."""
    base = vectors(spark, folder)
    points = projection.comparison(base, "label", base.select("row_id", "cluster"))
    return points.filter("x is not null and y is not null").select("row_id", "label", "cluster")


@checked(f"""WITH {VECTORS_SQL}, {_quota_sql("CAST(rating AS INTEGER)", "(SELECT ceil(0.2 * n) FROM total)")}
SELECT label AS truth, quota AS n FROM quota""")
def probe_test_rows(spark, folder):
    """Test rows of the probe per true class."""
    table_, _ = probe.evaluate_probe(vectors(spark, folder), "rating", multinomial=True)
    return table_.groupBy("truth").agg(F.sum("n").alias("n"))


ORACLE["missing_targets"] = """SELECT count(*) AS valid_rows, CAST(ceil(0.2 * count(*)) AS BIGINT) AS test_rows
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL"""


@query
def missing_targets(spark, folder):
    """Size of the probe's test part when some targets are missing."""
    from textrep.operators.sampling import train_test_split

    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    train, test = train_test_split(docs.select("doc_id", "quality"), "quality", key="doc_id")
    sizes = train.select(F.lit(0).alias("t")).unionByName(test.select(F.lit(1).alias("t")))
    return sizes.agg(F.count(F.lit(1)).alias("valid_rows"), F.sum("t").alias("test_rows"))

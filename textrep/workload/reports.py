"""Queries for formats, metric tables, checks, summaries, storage and streams."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from textrep.functions.formats import duration_seconds, elapsed_text, human_bytes
from textrep.operators import report
from textrep.operators.encoders import batch, tfidf
from textrep.operators.vocab import numbered
from textrep.plans.encode import load_svd, save_svd
from textrep.plans.job import run
from textrep.plans.preprocess import preprocess
from textrep.session import cut_lineage, work_path
from textrep.sources import reviews, store
from textrep.sources.runlogs import BAR_SOURCE, CLOCK_SOURCE, encoder_runtimes
from textrep.streaming import reviews as stream
from textrep.workload.encoders import STOP_WORDS
from textrep.workload.tables import CLEANED_SQL, RAW_SQL, raw_reviews, review_texts, sql_clean, table, vectors

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


@query("""WITH s AS (SELECT doc_id, n_chars * (CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 100 WHEN 2 THEN 100000 WHEN 3 THEN 100000000
ELSE 1000000000000 END)::BIGINT AS size FROM documents)
SELECT doc_id, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1024^2 THEN printf('%.2f KB', size / 1024::DOUBLE)
WHEN size < 1024^3 THEN printf('%.2f MB', size / (1024^2)::DOUBLE) WHEN size < 1024^4 THEN printf('%.2f GB', size / (1024^3)::DOUBLE)
ELSE printf('%.2f TB', size / (1024^4)::DOUBLE) END AS shown FROM s""")
def human_sizes(spark, folder):
    factor = F.element_at(F.array(*[F.lit(v).cast("long") for v in (1, 100, 10**5, 10**8, 10**12)]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", human_bytes(F.col("n_chars") * factor).alias("shown"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS s, CAST(floor(l_extendedprice / 3600) AS BIGINT) AS h FROM lineitem),
m AS (SELECT *, CAST(floor((s - h * 3600) / 60) AS BIGINT) AS m FROM s),
r AS (SELECT *, regexp_replace(printf('%05.2f', s - h * 3600 - m * 60), '\\.?0+$', '') AS r FROM m),
t AS (SELECT *, CASE WHEN h > 0 THEN printf('%d:%02d:%s', h, m, r) ELSE printf('%d:%s', m, r) END AS elapsed FROM r)
SELECT l_orderkey, l_linenumber, elapsed, round(s, 2) AS seconds FROM t""")
def durations(spark, folder):
    """Prices read as seconds, written as durations and read back."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", elapsed_text(F.col("l_extendedprice")).alias("elapsed")
    )
    return rows.withColumn("seconds", duration_seconds(F.col("elapsed")))


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id || ':' || (user_id % 60) || ':' || (value % 60)
WHEN 1 THEN (user_id % 60) || ':x' WHEN 2 THEN CAST(user_id AS VARCHAR) ELSE '1:2:3:' || user_id END AS t, user_id, value FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN round(user_id * 3600 + user_id % 60 * 60 + value % 60, 2) END AS seconds FROM s""")
def duration_forms(spark, folder):
    """Only complete durations are read; other shapes are null."""
    user, rest = F.col("user_id").cast("string"), F.pmod("user_id", F.lit(60)).cast("string")
    kind = F.pmod("event_id", F.lit(4))
    shown = (
        F.when(kind == 0, F.concat_ws(":", user, rest, (F.col("value") % 60).cast("string")))
        .when(kind == 1, F.concat(rest, F.lit(":x"))).when(kind == 2, user).otherwise(F.concat(F.lit("1:2:3:"), user))
    )
    return table(spark, folder, "events").select("event_id", duration_seconds(shown).alias("seconds"))


# Log lines made from events: the user names the file, the type the kind of line.
_LOG_SQL = """ev AS (SELECT event_id, ts, 'run_' || (user_id % 40) || CASE WHEN user_id % 5 = 0 THEN '_sbert' ELSE '' END || '.log' AS name,
user_id % 40 AS modified, event_type AS kind, CAST(floor(abs(value)) AS BIGINT) % 60 AS sec, event_id % 97 AS mins FROM events),
lines AS (SELECT *, kind = 'view' AS is_clock, kind = 'click' AS is_glove_bar, kind = 'error' AS is_sbert_bar,
 kind = 'signup' AND mins = 0 AS is_glove_command FROM ev),
enc(encoder) AS (VALUES ('sbert'), ('glove')),
files AS (SELECT encoder, name, max(modified) AS modified, bool_or(encoder = 'sbert' AND contains(name, 'sbert')) AS named,
 bool_or(encoder = 'glove' AND is_glove_command) AS command,
 bool_or(CASE encoder WHEN 'sbert' THEN is_sbert_bar ELSE is_glove_bar END) AS bar,
 arg_max(mins || ':' || lpad(CAST(sec AS VARCHAR), 2, '0'), event_id) FILTER (is_clock) AS clock,
 arg_max(mins || ':' || lpad(CAST(sec AS VARCHAR), 2, '0'), event_id) FILTER (CASE encoder WHEN 'sbert' THEN is_sbert_bar ELSE is_glove_bar END) AS bar_text,
 arg_max(sec + 0.5, event_id) FILTER (CASE encoder WHEN 'sbert' THEN is_sbert_bar ELSE is_glove_bar END) AS rate
 FROM lines CROSS JOIN enc GROUP BY 1, 2),
best AS (SELECT *, clock IS NOT NULL AND (named OR command) AS by_clock FROM files WHERE bar OR (clock IS NOT NULL AND (named OR command))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY encoder ORDER BY modified DESC, name DESC) AS r FROM best)
SELECT encoder, CASE WHEN by_clock THEN clock ELSE bar_text END AS elapsed, name AS path,
CAST(CASE WHEN NOT by_clock THEN rate END AS DOUBLE) AS throughput_per_second,
CASE WHEN by_clock THEN '/usr/bin/time -v' ELSE 'tqdm' END AS source FROM ranked WHERE r = 1"""


@query(f"WITH {_LOG_SQL}")
def runtime_logs(spark, folder):
    secs = F.lpad((F.floor(F.abs("value")).cast("long") % 60).cast("string"), 2, "0")
    mins = F.pmod("event_id", F.lit(97))
    rate = (F.floor(F.abs("value")).cast("long") % 60 + 0.5).cast("string")

    def bar(label: str):
        return F.concat(F.lit(f"{label}: 100%|####| 9/9 ["), mins.cast("string"), F.lit(":"), secs, F.lit("<00:00, "), rate, F.lit("it/s]"))

    kind = F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), mins.cast("string"), F.lit(":"), secs))
        .when(kind == "click", bar("Encode GloVe"))
        .when(kind == "error", bar("Encode sbert"))
        .when((kind == "signup") & (mins == 0), F.lit("python job.py --encoders glove"))
        .otherwise(F.lit("nothing to see"))
    )
    name = F.concat(
        F.lit("run_"), F.pmod("user_id", F.lit(40)).cast("string"),
        F.when(F.pmod("user_id", F.lit(5)) == 0, "_sbert").otherwise(""), F.lit(".log"),
    )
    lines = table(spark, folder, "events").select(
        name.alias("path"), F.pmod("user_id", F.lit(40)).alias("modified"), F.col("event_id").alias("line_no"), line.alias("line")
    )
    labels = {"sbert": ["Encode sbert"], "glove": ["Encode GloVe", "Encode glove"]}
    return encoder_runtimes(lines, labels).drop("elapsed_seconds")


_WIDE_SQL = """wide AS (SELECT event_type AS encoder, avg(value) AS nmi, CASE WHEN event_type <> 'view' THEN max(value) END AS ari,
CASE WHEN event_type = 'click' THEN 'NaN'::DOUBLE ELSE stddev_samp(value) END AS silhouette, count(*) AS n_clusters, 'value' AS label_column
FROM events GROUP BY event_type)"""


def _wide(spark, folder):
    """One row of figures per event type, in the shape of encoder metrics."""
    return table(spark, folder, "events").groupBy(F.col("event_type").alias("encoder")).agg(
        F.avg("value").alias("nmi"), F.max(F.when(F.col("event_type") != "view", F.col("value"))).alias("ari"),
        F.when(F.col("event_type") == "click", float("nan")).otherwise(F.stddev_samp("value")).alias("silhouette"),
        F.count(F.lit(1)).alias("n_clusters"), F.lit("value").alias("label_column"),
    )


@query(f"""WITH {_WIDE_SQL} SELECT encoder, 'NMI' AS metric, round(nmi, 6) AS score FROM wide
UNION ALL SELECT encoder, 'ARI', round(ari, 6) FROM wide WHERE ari IS NOT NULL
UNION ALL SELECT encoder, 'SILHOUETTE', round(silhouette, 6) FROM wide WHERE NOT isnan(silhouette)""")
def metric_unpivot(spark, folder):
    return report.score_rows(_wide(spark, folder)).withColumn("score", F.round("score", 6))


@query("""WITH old AS (SELECT event_type AS encoder, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' GROUP BY 1),
new AS (SELECT event_type AS encoder, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type >= 'm' AND event_id % 2 = 0 GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE encoder NOT IN (SELECT encoder FROM new)""")
def metric_upsert(spark, folder):
    events = table(spark, folder, "events")

    def figures(rows):
        return rows.groupBy(F.col("event_type").alias("encoder")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))

    old = figures(events.filter("event_type <> 'view'"))
    return store.upsert(old, figures(events.filter("event_type >= 'm' and event_id % 2 = 0")), ("encoder",))


@query("""WITH old AS (SELECT event_type AS encoder, count(*) AS rows, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' GROUP BY 1),
new AS (SELECT event_type AS encoder, count(*) AS rows, CAST(NULL AS DOUBLE) AS total, max(event_id) AS last FROM events
 WHERE event_type >= 'm' AND event_id % 2 = 0 GROUP BY 1)
SELECT coalesce(new.encoder, old.encoder) AS encoder, coalesce(new.rows, old.rows) AS rows, coalesce(new.total, old.total) AS total, last
FROM old FULL JOIN new ON old.encoder = new.encoder""")
def metric_overlay(spark, folder):
    events = table(spark, folder, "events")
    old = events.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("encoder")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total"))
    new = events.filter("event_type >= 'm' and event_id % 2 = 0").groupBy(F.col("event_type").alias("encoder")).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(None).cast("double").alias("total"), F.max("event_id").alias("last"))
    return store.overlay(old, new, ("encoder",))


@query(f"""WITH {_WIDE_SQL}, n AS (SELECT event_type AS encoder, count(*) AS rows FROM events GROUP BY 1)
SELECT upper(n.encoder) AS encoder, rows, 64 AS dim, CASE WHEN rows * 256 < 1024 THEN rows * 256 || ' B' WHEN rows * 256 < 1048576
THEN printf('%.2f KB', rows * 256 / 1024.0::DOUBLE) ELSE printf('%.2f MB', rows * 256 / 1048576.0::DOUBLE) END AS file_size,
CASE WHEN n.encoder <> 'view' THEN 'cuda' END AS device, CASE WHEN n.encoder <> 'view' THEN '0:' || lpad(CAST(rows % 60 AS VARCHAR), 2, '0') END AS embed_elapsed,
round(nmi, 6) AS cluster_nmi, round(ari, 6) AS cluster_ari, CAST(NULL AS BIGINT) AS iso_anomalies, rows * 2 AS inconsistencies,
'out/' || n.encoder AS umap_coords FROM n JOIN wide ON n.encoder = wide.encoder""")
def summary_join(spark, folder):
    """Event types as encoders; what a task did not measure stays null."""
    events = table(spark, folder, "events")
    kinds = events.groupBy(F.col("event_type").alias("encoder")).agg(F.count(F.lit(1)).alias("rows"))
    meta = kinds.withColumn("dim", F.lit(64))
    secs = F.lpad((F.col("rows") % 60).cast("string"), 2, "0")
    run = kinds.filter("encoder <> 'view'").select(
        "encoder", F.concat(F.lit("0:"), secs).alias("elapsed"), (F.col("rows") % 60).cast("double").alias("elapsed_seconds"),
        F.lit("cuda").alias("device"))
    logs = spark.createDataFrame([], "encoder string, elapsed string, elapsed_seconds double, source string")
    metrics = report.metric_rows(_wide(spark, folder).select("encoder", "nmi", "ari"), "clustering").unionByName(
        report.metric_rows(kinds.select("encoder", (F.col("rows") * 2).alias("inconsistency_count")), "anomaly"))
    paths = kinds.select("encoder", F.concat(F.lit("out/"), "encoder").alias("coords_path"))
    rows = report.summary(kinds, report.efficiency(meta, run, logs), metrics, paths)
    return rows.select(
        "encoder", "rows", "dim", "file_size", "device", "embed_elapsed", F.round("cluster_nmi", 6).alias("cluster_nmi"),
        F.round("cluster_ari", 6).alias("cluster_ari"), "iso_anomalies", "inconsistencies", "umap_coords")


@query("""WITH n AS (SELECT CASE source WHEN 'src1' THEN 'tfidf' WHEN 'src2' THEN 'sbert' ELSE source END AS encoder, count(*) AS rows FROM documents GROUP BY 1)
SELECT encoder, rows, 300 AS dim, rows * 1200 AS bytes, 1200.0::DOUBLE AS bytes_per_row,
CASE WHEN encoder = 'tfidf' THEN 'cpu' END AS device,
CASE WHEN encoder IN ('sbert', 'src3') THEN '9:59' WHEN rows % 2 = 0 THEN '0:' || lpad(CAST(rows % 60 AS VARCHAR), 2, '0')
 WHEN encoder = 'tfidf' THEN '7:00' END AS elapsed,
CASE WHEN encoder IN ('sbert', 'src3') THEN '/usr/bin/time -v' WHEN rows % 2 = 0 THEN 'internal_perf_counter' WHEN encoder = 'tfidf' THEN 'tqdm' END AS source FROM n""")
def efficiency(spark, folder):
    """Sources as encoders: wall clock first, then the timer, then a progress bar."""
    name = F.when(F.col("source") == "src1", "tfidf").when(F.col("source") == "src2", "sbert").otherwise(F.col("source"))
    kinds = table(spark, folder, "documents").groupBy(name.alias("encoder")).agg(F.count(F.lit(1)).alias("rows"))
    run = kinds.filter("rows % 2 = 0").select(
        "encoder", F.concat(F.lit("0:"), F.lpad((F.col("rows") % 60).cast("string"), 2, "0")).alias("elapsed"),
        F.lit(1.0).alias("elapsed_seconds"), F.lit(None).cast("string").alias("device"))
    clock = F.col("encoder") != "tfidf"
    logs = kinds.filter("encoder in ('sbert', 'src3', 'tfidf')").select(
        "encoder", F.when(clock, "9:59").otherwise("7:00").alias("elapsed"), F.lit(2.0).alias("elapsed_seconds"),
        F.when(clock, CLOCK_SOURCE).otherwise(BAR_SOURCE).alias("source"))
    rows = report.efficiency(kinds.withColumn("dim", F.lit(300)), run, logs)
    out = rows.select("encoder", "rows", "dim", "bytes", "bytes_per_row", "device", "elapsed", "source")
    return out.withColumn("source", F.when(F.col("elapsed").isNotNull(), F.col("source")))


_CHECKS = """n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM documents WHERE lang <> 'es') AS part,
 (SELECT count(*) FROM embeddings) AS vecs, (SELECT max(len(embedding)) FROM embeddings) AS dim),
c(encoder, check_name, expected, actual) AS (
SELECT 'table', 'column rating', 'present', 'present' UNION ALL SELECT 'table', 'column category', 'present', 'present'
UNION ALL SELECT 'table', 'column cleaned_text', 'present', 'missing'
UNION ALL SELECT 'hash', 'rows', docs::VARCHAR, part::VARCHAR FROM n UNION ALL SELECT 'hash', 'meta total_rows', docs::VARCHAR, docs::VARCHAR FROM n
UNION ALL SELECT 'hash', 'meta rows_written', docs::VARCHAR, part::VARCHAR FROM n UNION ALL SELECT 'hash', 'meta dim', '64', '64'
UNION ALL SELECT 'hash', 'meta complete', 'true', CASE WHEN part >= docs THEN 'true' ELSE 'false' END FROM n
UNION ALL SELECT 'given', 'rows', docs::VARCHAR, vecs::VARCHAR FROM n UNION ALL SELECT 'given', 'meta total_rows', docs::VARCHAR, 'missing' FROM n
UNION ALL SELECT 'given', 'meta rows_written', docs::VARCHAR, 'missing' FROM n UNION ALL SELECT 'given', 'meta dim', dim::VARCHAR, 'missing' FROM n
UNION ALL SELECT 'given', 'meta complete', 'true', 'missing' UNION ALL SELECT 'lost', 'embedding', 'present', 'missing')"""


@query(f"WITH {_CHECKS} SELECT encoder, check_name AS \"check\", expected, actual, expected = actual AS ok FROM c")
def validation(spark, folder):
    """A partly written vector table, one without a record and one that is missing."""
    docs = raw_reviews(spark, folder)
    texts = review_texts(spark, folder)
    path = work_path(spark, "vectors")
    store.write_embeddings(batch.encode(texts.filter("category <> 'es'")), path, "hashing", docs.count(), batch.HASH_DIM)
    tables = {"hash": spark.read.parquet(path), "given": vectors(spark, folder), "lost": None}
    metas = {"hash": store.read_meta(spark, path), "given": store.read_meta(spark, path + "-none")}
    return report.validate_inputs(docs, tables, metas)


@query("""SELECT (SELECT count(*) FROM labels) AS left_rows, (SELECT count(*) FROM documents) AS right_rows,
(SELECT count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS only_left,
(SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)) AS only_right,
0::BIGINT AS repeated, (SELECT count(*) FROM labels) = (SELECT count(*) FROM documents) AS ok""")
def alignment(spark, folder):
    return report.check_alignment(table(spark, folder, "labels"), table(spark, folder, "documents"), "doc_id")


@query("SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def aligned_rows(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    report.require_rows(docs)
    labels = table(spark, folder, "labels")
    return report.align(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, "doc_id")


@query("""SELECT 'given' AS kind, count(*) AS rows_written, (SELECT count(*) FROM embeddings) AS total_rows, 64 AS dim, true AS complete,
count(*) AS stored, round(sum(list_sum([x::DOUBLE FOR x IN embedding])), 4) AS total, true AS reused FROM embeddings""")
def embedding_store(spark, folder):
    """Vectors stored with their record; the second request finds and reuses them."""
    path = work_path(spark, "vectors")
    base = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    rows = base.count()
    store.materialize(spark, path, "given", rows, 64, lambda: base)
    again, reused = store.materialize(spark, path, "given", rows, 64, lambda: base.limit(0))
    sums = again.agg(
        F.count(F.lit(1)).alias("stored"),
        F.round(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))), 4).alias("total"),
    )
    meta = store.read_meta(spark, path).select("kind", "rows_written", "total_rows", "dim", "complete")
    one = meta.unionByName(sums, allowMissingColumns=True)
    return one.agg(*[F.max(c).alias(c) for c in one.columns]).withColumn("reused", F.lit(reused))


@query("SELECT l_returnflag AS encoder, 'lineitem' AS task, 'avg_price' AS metric, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1 "
       "UNION ALL SELECT l_returnflag, 'lineitem', 'rows', count(*)::DOUBLE FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1 "
       "UNION ALL SELECT 'A', 'lineitem', 'rows', 0.0::DOUBLE")
def metric_store(spark, folder):
    """Metric rows written twice as JSON; the second write replaces one row."""
    path = work_path(spark, "metrics")
    items = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("encoder"))
    wide = items.agg(F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("rows"))
    store.upsert_metrics(spark, path, report.metric_rows(wide, "lineitem"))
    fixed = wide.filter("encoder = 'A'").select("encoder", F.lit(0).alias("rows"))
    store.upsert_metrics(spark, path, report.metric_rows(fixed, "lineitem"))
    return store.read_metrics(spark, path)


@query("""SELECT event_id, event_type, value, CAST(row_number() OVER (ORDER BY value DESC, event_id) - 1 AS BIGINT) AS place FROM events""")
def sorted_csv(spark, folder):
    """Highest values first in a CSV; every line with its place in the order of the files."""
    path = work_path(spark, "sorted")
    rows = table(spark, folder, "events").select("event_id", "event_type", "value")
    store.write_sorted_csv(rows, path, F.col("value").desc(), "event_id")
    back = spark.read.schema("event_id long, event_type string, value double").option("header", True).csv(path)
    lines = back.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return numbered(lines, [F.col("file"), F.col("block"), F.col("line")], "place").select("event_id", "event_type", "value", "place")


@query(f"""WITH {CLEANED_SQL} SELECT category, count(*) AS rows, CAST(sum(length(cleaned_text)) AS BIGINT) AS chars FROM kept GROUP BY 1""")
def preprocess_job(spark, folder):
    """The whole job: JSON-lines files in, cleaned Parquet table out."""
    source, output = work_path(spark, "raw"), work_path(spark, "cleaned")
    raw = raw_reviews(spark, folder)
    _write_in_order(raw.select("rating", "text", "user_id", F.col("category").alias("asin"), "row_id"), "row_id", source)
    _as_jsonl(spark, source)
    preprocess(spark, source, output)
    kept = reviews.read_columns(spark, output, "asin", "cleaned_text")
    return kept.groupBy(F.col("asin").alias("category")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("cleaned_text")).alias("chars"))


@query(f"""WITH {CLEANED_SQL}, n AS (SELECT count(*) AS rows FROM kept) SELECT 'HASHING' AS encoder, rows, 64 AS dim,
CASE WHEN rows * 256 < 1048576 THEN printf('%.2f KB', rows * 256 / 1024.0::DOUBLE) ELSE printf('%.2f MB', rows * 256 / 1048576.0::DOUBLE) END AS file_size,
least(rows, 50000) AS umap_sample_size, true AS complete FROM n""")
def analysis_job(spark, folder):
    """All stages and tasks of the job with the hashing encoder."""
    source, output = work_path(spark, "raw"), work_path(spark, "out")
    raw_reviews(spark, folder).select("rating", "text", "user_id").write.json(source)
    _as_jsonl(spark, source)
    rows = run(spark, source, output, encoders=["hashing"], minimum_rows=1)
    measured = [c for c in rows.columns if c not in ("device",)]
    complete = F.lit(True)
    for column in measured:
        complete = complete & F.col(f"`{column}`").isNotNull()
    return rows.select("encoder", "rows", "dim", "file_size", "umap_sample_size", complete.alias("complete"))


def _write_in_order(rows, key: str, folder: str) -> None:
    """JSON lines without the key, whose order is that of the files and of the lines in a file."""
    rows.repartitionByRange(key).sortWithinPartitions(key).drop(key).write.json(folder)


def _write_for_batches(rows, folder: str, batches: int = 4) -> int:
    """JSON lines in at least as many files as ``batches``; returns the files of one batch."""
    rows = rows if rows.rdd.getNumPartitions() >= batches else rows.repartition(batches)
    rows.write.json(folder)
    return -(-len(rows.sparkSession.read.text(folder).inputFiles()) // batches)


def _as_jsonl(spark, folder: str) -> None:
    """Spark names its JSON files .json; the raw layout expects .jsonl."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.endswith(".json"):
            system.rename(status.getPath(), path.suffix(f"/{name}l"))


@query(f"""WITH {RAW_SQL}, texts AS (SELECT row_id, {sql_clean('text')} AS t FROM raw)
SELECT count(*) AS rows, true AS same FROM texts""")
def stored_model(spark, folder):
    """A fitted TF-IDF and SVD, saved, loaded and applied again with equal results."""
    texts = review_texts(spark, folder).select("row_id", F.col("cleaned_text").alias("text"))
    listed = cut_lineage(tfidf.listed_words(texts, STOP_WORDS), "words")
    model, words = tfidf.fit_weights(listed, 300)
    rows = tfidf.weigh(model, listed)
    svd = tfidf.truncated_svd(rows, len(words), 5, steps=2)
    path = work_path(spark, "model")
    model.write().overwrite().save(f"{path}/weights")
    save_svd(spark, svd, f"{path}/svd")
    loaded = tfidf.weigh(PipelineModel.load(f"{path}/weights"), listed)
    before = tfidf.project(rows, svd).withColumnRenamed("embedding", "a")
    after = tfidf.project(loaded, load_svd(spark, f"{path}/svd")).withColumnRenamed("embedding", "b")
    return before.join(after, "row_id").agg(F.count(F.lit(1)).alias("rows"), F.every(F.col("a") == F.col("b")).alias("same"))


@query(f"WITH {CLEANED_SQL} SELECT user_id, cleaned_text FROM kept")
def stream_preprocess(spark, folder):
    """Documents as JSON lines, streamed, cleaned and deduplicated."""
    source, out, state = (work_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    raw_reviews(spark, folder).select("rating", "text", "user_id").write.json(source)
    query_ = stream.write_stream(stream.clean_stream(stream.read_review_stream(spark, source)), out, state)
    query_.awaitTermination()
    return spark.read.parquet(out).select("user_id", "cleaned_text")


@query(f"""WITH {CLEANED_SQL} SELECT user_id AS category, count(*) AS raw_rows, count(*) FILTER (length(cleaned_text) < 10) AS dropped_short
FROM cleaned GROUP BY 1""")
def stream_statistics(spark, folder):
    """Running counts per source after every file was seen."""
    source, out, state = (work_path(spark, n) for n in ("stream-in", "stream-counts", "stream-state"))
    files = _write_for_batches(raw_reviews(spark, folder).select("rating", "text", F.col("user_id").alias("category")), source)
    lines = spark.readStream.schema("rating string, text string, category string").option("maxFilesPerTrigger", files).json(source)
    stream.write_counts(stream.running_statistics(lines), out, state).awaitTermination()
    return spark.read.parquet(out)


@query(f"""WITH {RAW_SQL} SELECT count(*) AS rows, 2::BIGINT AS runs, count(*) FILTER (category <> 'en') AS second_run FROM raw""")
def stream_embeddings(spark, folder):
    """Vectors for a table that grows: the second run encodes only the new rows."""
    source, out, state = (work_path(spark, n) for n in ("grow", "grow-out", "grow-state"))
    texts = review_texts(spark, folder).select("row_id", "category", "cleaned_text")
    texts.filter("category = 'en'").write.parquet(source)
    stream.encode_stream(spark, source, out, state, batch.encode).awaitTermination()
    first = spark.read.parquet(out).count()
    texts.filter("category <> 'en'").write.mode("append").parquet(source)
    stream.encode_stream(spark, source, out, state, batch.encode).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.agg(
        F.count_distinct("row_id").alias("rows"), F.lit(2).cast("long").alias("runs"),
        (F.count(F.lit(1)) - first).alias("second_run"))


@query("SELECT count(*) AS vectors, 64::BIGINT AS dim FROM documents")
def corpus_vectors(spark, folder):
    """Width and number of the vectors of the whole corpus."""
    rows = batch.encode(review_texts(spark, folder))
    report.require_rows(rows)
    return rows.agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dim"))


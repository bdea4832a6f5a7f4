"""Queries over texts: cleaning, statistics, samples, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrep.functions import text as tx
from textrep.functions.formats import category_of_file
from textrep.operators import keyindex, sampling, stats, vocab
from textrep.operators.clustering import distinct_labels
from textrep.operators.dedup import first_of_each, first_unseen
from textrep.operators.preprocess import clean_reviews, clean_reviews_legacy, preprocess_statistics
from textrep.sources.reviews import normalize, read_reviews
from textrep.session import cut_lineage, work_path
from textrep.workload.tables import CLEANED_SQL, RAW_SQL, TOKENS_SQL, raw_reviews, review_texts, sql_clean, sql_cut, sql_hash, sql_squeeze, sql_tokens, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


@query(f"WITH {CLEANED_SQL} SELECT row_id, rating, user_id, category, verified_purchase, cleaned_text FROM kept")
def clean_review_table(spark, folder):
    kept = clean_reviews(raw_reviews(spark, folder), ["row_id"])
    return kept.select("row_id", "rating", "user_id", "category", "verified_purchase", "cleaned_text")


@query(f"""WITH {RAW_SQL},
squeezed AS (SELECT *, {sql_clean('text', '')} AS full_text FROM raw),
first AS (SELECT *, row_number() OVER (PARTITION BY user_id, full_text ORDER BY row_id) AS copy FROM squeezed)
SELECT row_id, category, full_text AS cleaned_text FROM first WHERE copy = 1 AND length(full_text) >= 10""")
def clean_review_table_legacy(spark, folder):
    return clean_reviews_legacy(raw_reviews(spark, folder), ["row_id"]).select("row_id", "category", "cleaned_text")


@query(f"""SELECT page_id, {sql_cut(sql_clean('html'))} AS spaced, {sql_clean('html', '')} AS joined,
length({sql_clean('html')}) AS spaced_length FROM pages""")
def clean_html(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", tx.clean_text("html", 256).alias("spaced"), tx.squeeze(tx.replace_tags("html", "")).alias("joined"),
        tx.text_length(tx.clean_text("html")).alias("spaced_length"),
    )


@query(f"""SELECT doc_id AS row_id, TRY_CAST(CASE WHEN doc_id % 4 = 0 THEN 'n/a' ELSE CAST(doc_id % 5 + 1 AS VARCHAR) END AS DOUBLE)
AS rating, CAST(NULL AS VARCHAR) AS title, text, source AS user_id, CAST(NULL AS VARCHAR) AS asin,
CAST(NULL AS VARCHAR) AS parent_asin, doc_id % 2 = 0 AS verified_purchase, lang AS category, source || '.jsonl' AS source_file,
{sql_clean('text')} AS cleaned_text FROM documents""")
def normalized_reviews(spark, folder):
    odd = F.when(F.pmod("doc_id", F.lit(4)) == 0, "n/a").otherwise((F.pmod("doc_id", F.lit(5)) + 1).cast("string"))
    raw = table(spark, folder, "documents").select(
        F.col("doc_id").alias("row_id"), odd.alias("rating"), "text", F.col("source").alias("user_id"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, "true").otherwise("false").alias("verified_purchase"),
        F.col("lang").alias("category"), F.concat("source", F.lit(".jsonl")).alias("source_file"), "n_chars",
    )
    return normalize(raw)


@query(f"""WITH {RAW_SQL}, cleaned AS (SELECT *, {sql_clean('text')} AS cleaned_text FROM raw)
SELECT user_id, rating, category, min(cleaned_text) AS cleaned_text, count(*) AS copies FROM cleaned
GROUP BY user_id, rating, category, md5(cleaned_text)""")
def jsonl_scan(spark, folder):
    """Documents written as JSON lines, one folder per language, and read back."""
    path = work_path(spark, "jsonl")
    raw = raw_reviews(spark, folder).select("rating", "text", "user_id", "category", "verified_purchase")
    raw.write.partitionBy("category").option("ignoreNullFields", "true").json(path)
    lines = spark.read.schema("rating string, text string, user_id string, verified_purchase string, category string").json(path)
    cleaned = normalize(lines)
    return cleaned.groupBy("user_id", "rating", "category", F.md5("cleaned_text").alias("m")).agg(
        F.min("cleaned_text").alias("cleaned_text"), F.count(F.lit(1)).alias("copies")
    ).drop("m")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 3 = 1 THEN source || '.' || lang
ELSE 'amazon_reviews_' || lang || '_sample_x' END AS category FROM documents""")
def category_from_file(spark, folder):
    third = F.pmod("doc_id", F.lit(3))
    name = (
        F.when(third == 0, F.concat(F.lit("amazon_reviews_"), "lang", F.lit("_sample_"), "doc_id", F.lit(".jsonl")))
        .when(third == 1, F.concat("source", F.lit("."), "lang", F.lit(".jsonl")))
        .otherwise(F.concat(F.lit("amazon_reviews_"), "lang", F.lit("_sample_x.jsonl")))
    )
    return table(spark, folder, "documents").select("doc_id", category_of_file(name).alias("category"))


@query(f"""WITH {CLEANED_SQL},
a AS (SELECT category, count(*) AS raw_rows, count(*) FILTER (length(cleaned_text) < 10) AS dropped_short FROM cleaned GROUP BY 1),
b AS (SELECT category, count(*) AS kept_rows FROM kept GROUP BY 1)
SELECT a.category, raw_rows, dropped_short, coalesce(kept_rows, 0) AS kept_rows,
raw_rows - dropped_short - coalesce(kept_rows, 0) AS dropped_duplicates FROM a LEFT JOIN b USING (category)""")
def preprocess_stats(spark, folder):
    return preprocess_statistics(raw_reviews(spark, folder), ["row_id"])


@query("""SELECT min(doc_id) AS doc_id FROM documents d WHERE lang <> 'en' AND NOT EXISTS
(SELECT 1 FROM documents e WHERE e.lang = 'en' AND e.source = d.source AND e.text = d.text) GROUP BY source, text""")
def incremental_dedup(spark, folder):
    """English documents are loaded already; the others arrive."""
    docs = table(spark, folder, "documents")
    old, new = docs.filter("lang = 'en'"), docs.filter("lang <> 'en'")
    keys = ("source", "text")
    return first_unseen(new, old, ["doc_id"], keys).select("doc_id")


@query("""SELECT batch, count(*) AS arrived, count(*) FILTER (copy = 1) AS kept, max(doc_id) FILTER (copy = 1) AS last
FROM (SELECT doc_id, doc_id % 4 AS batch, row_number() OVER (PARTITION BY source, text ORDER BY doc_id % 4, doc_id) AS copy FROM documents) GROUP BY 1""")
def indexed_dedup(spark, folder):
    """Four batches loaded one after the other through the index of keys, the last one twice."""
    docs, path, keys = table(spark, folder, "documents").select("doc_id", "source", "text"), work_path(spark, "index"), ("source", "text")
    loaded = []
    for batch in (0, 1, 2, 3, 3):
        arrived = docs.filter(F.pmod("doc_id", F.lit(4)) == batch)
        new, _ = keyindex.load(first_of_each(arrived, ["doc_id"], keys), path, batch, keys)
        loaded.append(arrived.select("doc_id", F.lit(False).alias("new")).union(new.select("doc_id", F.lit(True).alias("new"))))
    rows = reduce(DataFrame.union, loaded[:3] + loaded[4:]).withColumn("batch", F.pmod("doc_id", F.lit(4)))
    return rows.groupBy("batch").agg(
        F.count_if(~F.col("new")).alias("arrived"), F.count_if(F.col("new")).alias("kept"), F.max(F.when(F.col("new"), F.col("doc_id"))).alias("last"))


@query("SELECT lang AS category, count(*) AS n FROM documents GROUP BY 1")
def eda_category(spark, folder):
    return stats.category_counts(raw_reviews(spark, folder))


@query(f"WITH {RAW_SQL} SELECT CAST(rating AS DOUBLE) AS rating, count(*) AS n FROM raw GROUP BY 1")
def eda_rating(spark, folder):
    return stats.rating_counts(raw_reviews(spark, folder))


@query(f"""WITH {RAW_SQL} SELECT count(*) AS total_rows,
round(avg(CASE WHEN verified_purchase THEN 1.0 WHEN NOT verified_purchase THEN 0.0 END) * 100, 6) AS verified_percent FROM raw""")
def eda_verified(spark, folder):
    found = stats.verified_percent(raw_reviews(spark, folder))
    return found.withColumn("verified_percent", F.round("verified_percent", 6))


_MEASURES = f"""m AS (SELECT 'text_length' AS measure, length(text) AS v FROM documents
UNION ALL SELECT 'word_count', len({sql_tokens(sql_squeeze("coalesce(text, '')"))}) FROM documents)"""


@query(f"""WITH {_MEASURES} SELECT measure, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
min(v) AS min, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90,
round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, max(v) AS max FROM m GROUP BY measure""")
def eda_lengths(spark, folder):
    found = stats.describe(
        raw_reviews(spark, folder), {"text_length": tx.text_length("text"), "word_count": tx.word_count("text")}
    )
    return found.select(
        "measure", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
        *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99")], "max",
    )


@query(f"""WITH {CLEANED_SQL} SELECT row_id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY row_id) AS r
FROM kept) WHERE r <= 25""")
def first_n_per_category(spark, folder):
    kept = clean_reviews(raw_reviews(spark, folder), ["row_id"])
    return sampling.first_per_group(kept, "category", ["row_id"], 25).select("row_id", "category")


@query(f"""WITH {RAW_SQL} SELECT row_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY {sql_hash('row_id')}, row_id)
AS r FROM raw) WHERE r <= 30""")
def sample_per_rating(spark, folder):
    return sampling.balanced_rating_sample(raw_reviews(spark, folder), 150).select("row_id", "rating")


@query(f"""WITH {RAW_SQL} SELECT CAST(rating AS DOUBLE) AS rating, count(*) AS seen, least(count(*), 30) AS kept FROM raw GROUP BY 1""")
def sample_rating_counts(spark, folder):
    raw = raw_reviews(spark, folder)
    return sampling.sample_counts(raw, sampling.balanced_rating_sample(raw, 150))


@query(f"SELECT doc_id FROM documents ORDER BY {sql_hash('doc_id')}, doc_id LIMIT 120")
def uniform_sample(spark, folder):
    return sampling.uniform_sample(table(spark, folder, "documents").select("doc_id"), 120, "doc_id")


_QUOTAS = """counts AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
share AS (SELECT lang, n, n / (SELECT sum(n) FROM counts)::DOUBLE * {size} AS share FROM counts),
quota AS (SELECT lang, n, CAST(floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, lang DESC)
          <= {size} - (SELECT sum(floor(share)) FROM share) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM share)"""


@query(f"WITH {_QUOTAS.format(size=137)} SELECT lang, n, quota FROM quota")
def stratified_quota(spark, folder):
    return sampling.stratified_quotas(table(spark, folder, "documents"), "lang", 137)


@query(f"""WITH {_QUOTAS.format(size=137)} SELECT doc_id, lang FROM (SELECT doc_id, d.lang, quota, row_number() OVER
(PARTITION BY d.lang ORDER BY {sql_hash('doc_id')}, doc_id) AS r FROM documents d JOIN quota q ON d.lang = q.lang) WHERE r <= quota""")
def stratified_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return sampling.stratified_sample(docs, "lang", 137, "doc_id")


@query("""WITH counts AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1),
size AS (SELECT ceil(0.2 * sum(n)) AS s, sum(n) AS total FROM counts),
share AS (SELECT quality, n, n / total::DOUBLE * s AS share, s FROM counts, size),
quota AS (SELECT quality, n, CAST(floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, quality DESC)
 <= s - (SELECT sum(floor(share)) FROM share) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM share)
SELECT quality, n - quota AS train_rows, quota AS test_rows FROM quota""")
def split_sizes(spark, folder):
    train, test = sampling.train_test_split(table(spark, folder, "labels"), "quality", key="doc_id")
    parts = train.select("quality", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        test.select("quality", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return parts.groupBy("quality").agg(F.sum("a").alias("train_rows"), F.sum("b").alias("test_rows"))


@query(f"WITH {TOKENS_SQL} SELECT token, count(*) AS cnt FROM tok GROUP BY token")
def token_counts(spark, folder):
    return vocab.token_counts(review_texts(spark, folder), tx.tokens("cleaned_text"))


@query(f"WITH {TOKENS_SQL} SELECT DISTINCT token FROM tok")
def vocabulary(spark, folder):
    return vocab.vocabulary(review_texts(spark, folder), tx.tokens("cleaned_text"))


_TOP = """top AS (SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 AS INTEGER) AS id FROM
(SELECT token, count(*) AS cnt FROM tok GROUP BY token HAVING count(*) >= {min_count}) ORDER BY cnt DESC, token LIMIT {size})"""


@query(f"WITH {TOKENS_SQL}, {_TOP.format(min_count=5, size=1000)} SELECT token, cnt, id FROM top")
def vocabulary_topk(spark, folder):
    counts = vocab.token_counts(review_texts(spark, folder), tx.tokens("cleaned_text"))
    return vocab.ranked_vocabulary(counts, 1000, 5)


@query(f"""WITH {TOKENS_SQL} SELECT token, cnt, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 AS INTEGER) AS id FROM
(SELECT token, count(*) AS cnt FROM tok GROUP BY token HAVING count(*) >= 2)""")
def vocabulary_uncapped(spark, folder):
    counts = vocab.token_counts(review_texts(spark, folder), tx.tokens("cleaned_text"))
    return vocab.ranked_vocabulary(counts, 0, 2)


@query(f"""WITH {TOKENS_SQL}, known AS (SELECT DISTINCT token FROM tok WHERE category = 'en'),
words AS (SELECT DISTINCT token FROM tok)
SELECT count(*) FILTER (token IN (SELECT token FROM known)) AS covered_words, count(*) AS vocabulary_size FROM words""")
def coverage(spark, folder):
    """Share of the corpus tokens that the English texts know."""
    texts = review_texts(spark, folder).withColumn("tokens", tx.tokens("cleaned_text"))
    known = vocab.vocabulary(texts.filter("category = 'en'"), "tokens")
    return vocab.coverage(vocab.vocabulary(texts, "tokens"), known)


@query(f"""WITH {TOKENS_SQL}, {_TOP.format(min_count=5, size=50000)},
ids AS (SELECT row_id, id, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS p FROM tok JOIN top USING (token)),
pairs AS (SELECT a.id AS a, b.id AS b, 60 // (b.p - a.p) AS w FROM ids a JOIN ids b ON a.row_id = b.row_id AND b.p BETWEEN a.p + 1 AND a.p + 5),
both_ways AS (SELECT a, b, w FROM pairs UNION ALL SELECT b, a, w FROM pairs)
SELECT a AS row_id, b AS col_id, round(sum(w) / 60.0, 6) AS value FROM both_ways GROUP BY 1, 2""")
def cooccurrence(spark, folder):
    texts = cut_lineage(review_texts(spark, folder).select("row_id", tx.tokens("cleaned_text").alias("tokens")), "tokens")
    top = vocab.ranked_vocabulary(vocab.token_counts(texts, "tokens"), 50_000, 5)
    cells = vocab.cooccurrence(vocab.token_ids(texts, "tokens", top))
    return cells.withColumn("value", F.round("value", 6))


@query("SELECT lang AS class, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code, (SELECT count(DISTINCT lang) FROM documents) AS classes "
       "FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def class_list(spark, folder):
    """Sorted classes with their numbers, and how many there are."""
    docs = table(spark, folder, "documents")
    listed = vocab.label_codes(docs.select("lang").filter("lang is not null").distinct(), "lang")
    return listed.select(F.col("lang").alias("class"), "code", F.lit(distinct_labels(docs, "lang")).cast("long").alias("classes"))


@query("SELECT 'documents' AS name, count(*) AS rows, 'doc_id,text,lang,source,n_chars' AS columns FROM documents "
       "UNION ALL SELECT 'lineitem', count(*), 'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
       "l_returnflag,l_linestatus,l_shipdate' FROM lineitem")
def table_shape(spark, folder):
    """Row counts from the file footers, and the column names."""
    parts = [
        df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), F.lit(",".join(df.columns)).alias("columns"))
        for name, df in ((n, table(spark, folder, n)) for n in ("documents", "lineitem"))
    ]
    return parts[0].unionByName(parts[1])


@query("""WITH coded AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN source END AS label FROM documents),
ranks AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS code FROM coded WHERE label IS NOT NULL GROUP BY label)
SELECT doc_id, c.label, CAST(coalesce(code, -1) AS INTEGER) AS code FROM coded c LEFT JOIN ranks r ON c.label = r.label""")
def label_codes(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", F.when(F.pmod("doc_id", F.lit(11)) != 0, F.col("source")).alias("label")
    )
    return vocab.label_codes(docs, "label")

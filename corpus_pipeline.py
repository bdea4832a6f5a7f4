"""A training corpus from ``documents``: five stages, each written and read again by the next.

Every stage keeps the columns it is given, extra ones too; the last adds
``pieces``. Null and empty texts have no language and go in the first stage. A
row without ``doc_id`` is a copy of nothing. Rows with the same id and text are
copies of each other, and one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.llm import decontaminate, language, minhash, personal, pieces
from textrep.llm.frames import free_name, remainder, sent
from textrep.session import cut_lineage, spread
from textrep.workload.tables import table

#: A text must share this part of its trigrams with its language; prose has 0.9 and noise nearly nothing.
LEAST_LANGUAGE = 0.2
#: Similarity of near-duplicates in hundredths, and bands that miss it once in 300,000 pairs.
LEAST_SIMILAR, BANDS = 80, 32
MOST_ID_BYTES = 32 << 20
#: Rows of an Arrow batch at most: buffers of 10,000 whole texts stay in an executor's memory outside its heap.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def small_batches(spark: SparkSession) -> None:
    """Sets the session to batches of at most ``BATCH_ROWS`` rows; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages of the table; others, and texts without letters, go."""
    small_batches(spark)
    filters = language.learn(docs.where(F.coalesce(remainder("doc_id", 4), F.lit(0)) != 2).select("text", "lang"))
    found = free_name(docs, "language")
    out = language.language(docs, filters, found)
    return out.where((F.col(found)["lang"] != language.UNKNOWN) & (F.col(found)["score"] >= LEAST_LANGUAGE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (of equal ids, one text) of each group of near-duplicates.

    Rows are told apart by a number of their own, so texts that share an id go or
    stay by their own group. Texts without words are copies only of equal rows.
    """
    small_batches(spark)
    row = free_name(docs, "row")
    placed = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = placed.where("doc_id IS NOT NULL").select(F.col(row).alias("row"), "doc_id", "text")
    found = minhash.near_duplicates(texts.select("row", "text"), "row", least=LEAST_SIMILAR, bands=BANDS)
    place = F.struct("doc_id", F.xxhash64("text").alias("hash"), "row")
    empty = F.col("n_shingles") == 0
    members = found.select("row", F.when(~empty, F.col("component_id")).alias("group"), empty.alias("empty")).join(texts.select("row", place.alias("place")), "row")
    of = [F.col("group"), *(F.when(F.col("empty"), F.col("place")[c]).alias(f"_{c}") for c in ("doc_id", "hash"))]
    members = cut_lineage(members.select("row", *of, "place"), "members")
    first = members.groupBy("group", "_doc_id", "_hash").agg(F.min("place").alias("first")).select(F.col("first.row").alias("row"))
    dropped = cut_lineage(members.select("row").join(first, "row", "left_anti"), "dropped").withColumnRenamed("row", row)
    return placed.join(_few(dropped), row, "left_anti").select(*docs.columns)


def _few(ids: DataFrame) -> DataFrame:
    marked = sent(ids, 8, MOST_ID_BYTES)
    return ids if marked is None else marked


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    small_batches(spark)
    found = free_name(docs, "found")
    out = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"), found)
    return out.where(F.size(F.col(found)["spans"]) == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; ``n_chars`` follows the text."""
    found = free_name(docs, "found")
    out = personal.find_personal(docs, found).withColumn("text", personal.mask(F.col("text"), F.col(found))).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ``pieces``, piece ids that decode to the text."""
    small_batches(spark)
    coded = free_name(docs, "coded")
    out = pieces.encode(docs, coded)
    return out.select(*docs.columns, F.col(coded)["ids"].alias(free_name(docs, "pieces")))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece", encoding),
]

#: Fitted filters and drawn pieces have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs, f"stage-{i + 1}")
    return docs

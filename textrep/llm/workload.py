"""Queries over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textrep.llm import codes, conversations, decontaminate, embeddings, language, minhash, personal, pieces, quality, scoring, substrings, tokens, urls
from textrep.llm.frames import remainder
from textrep.session import spread, work_path
from textrep.workload.tables import table


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(texts(spark, folder))


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder)
    out = scoring.score_documents(docs, docs.where(remainder("doc_id", 7) != 2))
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)))


def op3_personal(spark: SparkSession, folder: str) -> DataFrame:
    return personal.find_personal(texts(spark, folder), "found").select("doc_id", *personal.span_columns("found"))


def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(texts(spark, folder))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_benchmark(texts(spark, folder), table(spark, folder, "benchmark"), "found", keep=["doc_id"])
    return found.select("doc_id", *decontaminate.hit_columns("found"))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id").withColumn("rest", remainder("doc_id", 4))
    filters = language.learn(docs.where("rest <> 2"))
    out = language.language(docs.select("doc_id", "text", "rest"), filters, "found", keep=["doc_id", "rest"])
    return out.select("doc_id", F.coalesce(F.col("rest") == 2, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score")


def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(texts(spark, folder)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder).withColumn("rest", remainder("doc_id", 5))
    known = quality.labelled(docs.where("rest <> 0"), table(spark, folder, "labels"), "quality")
    out = quality.quality(docs, quality.learn(known), "found", keep=["doc_id", "rest"])
    score = F.col("found.score")
    return out.select(
        "doc_id",
        F.coalesce(F.col("rest") == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    path = work_path(spark, "token-files")
    tokens.write_tokens(texts(spark, folder), path, model)
    found = tokens.read_tokens(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spread(table(spark, folder, "conversations"), "conv_id")))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.compress(spread(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"), "vec_id"))


_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW.format('text')}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
one AS (SELECT doc_id, unnest(s) AS g FROM sets),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met >= 85 * (x.n + y.n - met)),
two AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM sizes JOIN reach ON doc_id = a GROUP BY doc_id, n"""

OP5_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce({_LOW.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(coalesce({_LOW.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT d.doc_id, d.i, d.n, p.item_id FROM dwin d JOIN win p ON d.n = p.n AND d.g = p.g),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP7_SQL = rf"""
WITH cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                              ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (SELECT page_id, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict), length(rule_host) + length(rule_path)) AS best
        FROM part JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM part LEFT JOIN fit USING (page_id)"""

OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 12] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
low AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM win JOIN low USING (g) WHERE low < doc_id),
sets AS (SELECT doc_id, list(place) AS gone FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ')
                   ELSE coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)], ' '), '') END) AS kept_sha256
FROM w LEFT JOIN sets USING (doc_id)"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS low FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN deg ON deg.a = vec_id"""

_CRC = """(xor(list_reduce([ascii(c) FOR c IN string_split({0}, '')]::BIGINT[], lambda x, c: list_reduce(range(8), lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(x, c)), 4294967295::BIGINT), 4294967295))"""


def _way(state: str, cost: str, audit: str, given: str = "true") -> str:
    return f"CASE WHEN {given} THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{audit}') ELSE far END"


_FAR = "struct_pack(c := 1000000000::BIGINT, a := '')"
_OPENED = {
    0: "s0", 1: "s1",
    2: f"list_min([s2, {_way('s0', '3', 'I')}, {_way('s1', '3', 'I')}, {_way('s3', '3', 'I')}])",
    3: f"list_min([s3, {_way('s2', '3', 'I')}, {_way('s0', '6', 'II')}, {_way('s1', '6', 'II')}])",
}
_STEPS = {
    0: [_way("w0", "4", "D")],
    1: [_way("w1", "4", "D"), _way("w0", "late", "K", "role = 0 AND NOT gone")],
    2: [_way("w2", "4", "D"), *(x for w in ("w0", "w1", "w3") for x in (_way(w, "late", "K", "role = 1 AND NOT gone"), _way(w, "late + 3", "R", "NOT gone")))],
    3: [_way("w3", "4", "D"), _way("w2", "late", "K", "role = 2 AND NOT gone"), _way("w2", "late + 3", "R", "NOT gone")],
}
OP12_SQL = rf"""
WITH RECURSIVE hurt AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
said AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, copy,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hurt CROSS JOIN range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS place,
    coalesce(list_position(['s', 'u', 'a'], role[1]) - 1, 3) AS role_number, right(rtrim(text, E' 	
'), 1) AS last FROM said),
seen AS MATERIALIZED (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(role_number) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
counts AS (SELECT conv_id, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(before IS NOT NULL AND before * 4 + role_number NOT IN (1, 6, 9)) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) AS n FROM seen GROUP BY conv_id),
steps AS MATERIALIZED (SELECT conv_id, place, role_number AS role, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM seen),
ways AS (SELECT conv_id, 0::BIGINT AS place, struct_pack(c := 0::BIGINT, a := '') AS s0, {_FAR} AS s1, {_FAR} AS s2, {_FAR} AS s3 FROM counts
    UNION ALL SELECT conv_id, place, {", ".join(f"list_min([{', '.join(_STEPS[i])}])" for i in range(4))}
    FROM (SELECT steps.conv_id, steps.place, steps.role, gone, late, far, {", ".join(f"{_OPENED[i]} AS w{i}" for i in range(4))}
          FROM (SELECT *, {_FAR} AS far FROM ways) w JOIN steps ON steps.conv_id IS NOT DISTINCT FROM w.conv_id AND steps.place = w.place + 1)),
best AS (SELECT w.conv_id, list_min([s0, {_OPENED[3]}]) AS way, {", ".join(c for c in ("blank", "duplicate", "truncated", "illegal", "gaps"))}
    FROM (SELECT *, {_FAR} AS far FROM ways) w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.place),
edits AS (SELECT conv_id, i, way.a[i] AS edit, CAST(length(replace(way.a[1:i], 'I', '')) AS BIGINT) AS place FROM (SELECT conv_id, way, unnest(range(1, length(way.a) + 1)) AS i FROM best)),
lines AS (SELECT e.conv_id, i, edit, s.role, CASE WHEN edit = 'I' THEN '' ELSE s.text END AS text,
    row_number() OVER (PARTITION BY e.conv_id ORDER BY i) - 1 AS out, first_value(edit = 'K' AND s.role_number = 0) OVER (PARTITION BY e.conv_id ORDER BY i) AS led
    FROM edits e LEFT JOIN seen s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.place = e.place AND edit <> 'I' WHERE edit <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (out - CASE WHEN led THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS text
    FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(way.c, 0) AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(fixed.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM o.conv_id"""

_NEAREST = """(SELECT pos, part, n, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(part, entry)]), e := e)) AS best
FROM d JOIN {0} USING (pos) GROUP BY pos, part, n)"""
_ROUND = f"""a{{1}} AS MATERIALIZED (SELECT pos, part, n, best.e AS e FROM {_NEAREST.format("c{0}")}),
m{{1}} AS (SELECT pos, e, list(x ORDER BY i) AS mean FROM (SELECT pos, e, i, CAST((sum(n * part[i]) - ((sum(n * part[i]) % sum(n)) + sum(n)) % sum(n)) // sum(n) AS BIGINT) AS x
    FROM a{{1}} CROSS JOIN range(1, 1 + (SELECT max(len(part)) FROM d)) t(i) GROUP BY ALL) GROUP BY pos, e),
c{{1}} AS MATERIALIZED (SELECT pos, e, coalesce(mean, entry) AS entry FROM c{{0}} LEFT JOIN m{{1}} USING (pos, e)),"""
OP13_SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, pos, q[pos * (len(q) // 8) + 1:(pos + 1) * (len(q) // 8)] AS part FROM v CROSS JOIN range(8) t(pos)),
d AS MATERIALIZED (SELECT pos, part, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL),
c0 AS MATERIALIZED (SELECT pos, e, part AS entry FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 16) JOIN p USING (vec_id)),
{" ".join(_ROUND.format(i, i + 1) for i in range(6))}
last AS MATERIALIZED (SELECT pos, part, best.e AS e, best.d AS d FROM {_NEAREST.format("c6")}),
code AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM p JOIN last USING (pos, part) GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(array_to_string(flatten(list(entry ORDER BY pos, e)), ',')) FROM c6) AS codebooks_sha256
FROM v JOIN code USING (vec_id)"""

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_language_model": op2_language_model,
    "op3_personal": op3_personal,
    "op4_pieces": op4_pieces,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_url_filters": op7_url_filters,
    "op8_substring": op8_substring,
    "op9_quality": op9_quality,
    "op10_embeddings": op10_embeddings,
    "op11_token_files": op11_token_files,
    "op12_conversations": op12_conversations,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE = {
    "op1_minhash": OP1_SQL,
    "op5_decontaminate": OP5_SQL,
    "op7_url_filters": OP7_SQL,
    "op8_substring": OP8_SQL,
    "op10_embeddings": OP10_SQL,
    "op12_conversations": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}

"""One registered query for each operator, over its whole table, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality, toxicity
from .bottom_k import near_duplicates
from .collocations import collocations
from .conversations import damaged, repaired
from .decontaminate import contaminated
from .fuzzy import fingerprints
from .mixing import mix
from .ngram_join import similar_components
from .pii import pseudonymised
from .repeats import without_repeats
from .tables import table, written
from .warc import archive, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Words of a text, lower-cased in A-Z only, and its distinct five-word shingles.
SQL_WORDS = """
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[\\x20\\x09-\\x0D]+'), lambda x: x != '')"""
SQL_SHINGLES = """
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END"""


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


QUERIES["op1_ngram_jaccard_join"] = op1_ngram_jaccard_join
SQL["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, {SQL_SHINGLES} AS s FROM w),
sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
n AS (SELECT doc_id, len(s) AS n FROM sets),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY n.doc_id, n.n"""


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    )


QUERIES["op3_source_mixing"] = op3_source_mixing
SQL_SIZE = "len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x != ''))::BIGINT"
#: Tables ``sized`` and ``plan`` from ``{docs}``: the sizes and every source's target.
SQL_MIX = f"""
sized AS (SELECT *, {SQL_SIZE} AS size FROM {{docs}}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS ceiling FROM src),
levels AS (SELECT *, ceiling / weight AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(ceiling) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM weighed WINDOW b AS (ORDER BY ceiling / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, source_size, least(ceiling, coalesce(weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1), ceiling)) AS target FROM levels),
mixed AS (SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
    FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)"""
SQL["op3_source_mixing"] = f"""
WITH {SQL_MIX.format(docs="documents")}
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM mixed"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES["op6_benchmark_decontamination"] = op6_benchmark_decontamination
SQL["op6_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents), b AS (SELECT item_id, {SQL_WORDS} AS w FROM benchmark),
ds AS (SELECT doc_id, unnest({SQL_SHINGLES}) AS g FROM d), bs AS (SELECT item_id, unnest({SQL_SHINGLES}) AS g FROM b),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared FROM ds JOIN bs USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING 4 * count(*) >= 3 * n"""


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(archive(table(spark, sf_dir, "pages")), "archive")
    return records(stored, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op4_warc_bundles"] = op4_warc_bundles
SQL["op4_warc_bundles"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first != page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""


def remainder(key: str, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % m


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES["op2_document_fingerprints"] = op2_document_fingerprints


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(remainder("doc_id", 4) != 2))
    scored = toxicity.score(docs, model, spans=False)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES["op5_toxicity"] = op5_toxicity


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(remainder("doc_id", 5) != 0))
    scored = quality.score(docs, model, detail=False)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES["op8_line_quality"] = op8_line_quality


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(remainder("doc_id", 3) != 1))
    found = language.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES["op10_language_id"] = op10_language_id


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), detail=False)


QUERIES["op7_repeated_bytes"] = op7_repeated_bytes


def pii_key(spark: SparkSession) -> str:
    """The session's secret; without one a key that is public, for tests and comparisons only."""
    return spark.conf.get("spark.folioscope.pii.key", "public test key")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.col("n_found").cast("long").alias("n_found"))


QUERIES["op9_pii_pseudonyms"] = op9_pii_pseudonyms


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES["op11_phrase_collocations"] = op11_phrase_collocations
SQL["op11_phrase_collocations"] = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x != '') AS w FROM d),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM p, range(1, 6) t(m)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, f AS a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
cut AS (SELECT c.lang, c.m, c.phrase, a, k, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score FROM c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ')
    JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:c.m], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND f.f >= b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""


def op12_bottom_k_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op12_bottom_k_duplicates"] = op12_bottom_k_duplicates
SQL["op12_bottom_k_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, {SQL_SHINGLES.replace("len(w) < 5", "len(w) < 3").replace("len(w) - 3", "len(w) - 1").replace("i+4", "i+2")} AS s FROM w),
sh AS (SELECT doc_id, unnest(s) AS g FROM sets),
n AS (SELECT doc_id, len(s) AS n FROM sets),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON edges.x = reach.r)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r) AS component_id, n.doc_id = min(r) AS kept FROM reach JOIN n USING (doc_id) GROUP BY n.doc_id, n.n"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(conversations, damaged(conversations))


QUERIES["op13_conversation_repair"] = op13_conversation_repair
SQL["op13_conversation_repair"] = """
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
ruled AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ord(key[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS rule FROM src),
made AS (SELECT conv_id, turn, CASE WHEN rule = 4 THEN 'user' ELSE role END AS role, CASE rule WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN rule = 3 THEN [0, 1] ELSE [0] END) AS copy FROM ruled WHERE rule != 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM made),
rows AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM numbered),
-- from last role p, by k inserts, to last role q: inserts after the start and a system row begin with a user
ins(p, q, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (0, 2, 3), (1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 2, 3), (2, 2, 0), (2, 3, 1), (2, 2, 2), (2, 3, 3), (3, 3, 0), (3, 2, 1), (3, 3, 2), (3, 2, 3)),
steps AS (SELECT conv_id, i, k, p, e.s, q AS mid, e.cost AS c, e.edit AS edit FROM rows, ins, LATERAL (
    SELECT q AS s, 3 AS cost, 'D' AS edit
    UNION ALL SELECT CASE WHEN q = 2 THEN 3 ELSE 2 END, 2 + (fault = 3)::INT, 'R' WHERE fault NOT IN (1, 2)
    UNION ALL SELECT CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, (fault = 3)::INT, 'K'
        WHERE fault NOT IN (1, 2) AND (initial = 's' AND q = 0 OR initial = 'u' AND q != 2 OR initial = 'a' AND q = 2)) e),
walk(conv_id, i, s, cost, script) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0, 0, '' FROM rows
    UNION ALL SELECT w.conv_id, t.i, t.s, min((w.cost + 2 * t.k + t.c, w.script || repeat('I', t.k) || t.edit))[1], min((w.cost + 2 * t.k + t.c, w.script || repeat('I', t.k) || t.edit))[2]
    FROM walk w JOIN steps t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 AND t.p = w.s GROUP BY w.conv_id, t.i, t.s),
ends AS (SELECT conv_id, max(i) AS i FROM rows GROUP BY conv_id),
best AS (SELECT w.conv_id, min((w.cost + 2 * k, w.script || repeat('I', k))) AS x FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i JOIN ins ON p = w.s AND q IN (0, 3) GROUP BY w.conv_id),
-- the script applied: the last role after every edit, and the row that an edit is about
edits AS (SELECT conv_id, x[1] AS cost, x[2] AS audit, unnest(range(1, length(x[2]) + 1)) AS j FROM best),
placed AS (SELECT conv_id, j, audit[j] AS edit, length(replace(left(audit, j::INT), 'I', '')) AS i FROM edits),
lines AS (SELECT p.conv_id, j, edit, r.role, r.text, r.initial = 's' AND edit = 'K' AS sys,
    count(*) FILTER (WHERE NOT (r.initial = 's' AND edit = 'K') OR edit = 'I') OVER (PARTITION BY p.conv_id ORDER BY j) AS nth
    FROM placed p LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE edit != 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role ELSE CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t FROM lines GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
    count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x[1], 0)::BIGINT AS cost, coalesce(x[2], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""

"""Registered queries of the emotion analytics, over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context as C
from ..operators import headings as H
from ..operators import jobs as J
from ..operators import layout as L
from ..operators import profiles as P
from ..operators import scoring as S
from ..operators import segment as G
from ..sources import books as B
from ..sources import sinks as K
from .registry import QUERIES, SQL, query, r4, read

LABELS = ["neutral", *[f"L{k:02d}" for k in range(1, 28)]]


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as a long score table: book = label % 3, chapter = label, scene = vec_id."""
    e = read(spark, sf, "embeddings")
    keys = [(F.col("label") % 3).alias("book_id"), F.col("label").alias("chapter_index"), F.col("vec_id").alias("scene_index"), (1 + F.col("vec_id") % 5).cast("double").alias("weight")]
    logits = F.transform(F.slice("embedding", 1, 28), lambda x: 8 * x.cast("double"))
    return e.select(*keys, F.explode(S.sigmoid_scores(logits, LABELS)).alias("label", "score")).withColumn("score", F.round("score", 6))


BASE = """
e AS (SELECT label % 3 AS book_id, label AS chapter_index, vec_id AS scene_index, (1 + vec_id % 5)::DOUBLE AS weight, unnest(range(0, 28)) AS k, embedding FROM embeddings),
s AS (SELECT book_id, chapter_index, scene_index, weight, CASE WHEN k = 0 THEN 'neutral' ELSE 'L' || lpad(k::VARCHAR, 2, '0') END AS label,
      round(1 / (1 + exp(-8 * embedding[k + 1]::DOUBLE)), 6) AS score FROM e)"""
PROFILE = BASE + """,
sw AS (SELECT book_id, chapter_index, sum(weight) AS w, count(*) AS scene_count FROM (SELECT DISTINCT book_id, chapter_index, scene_index, weight FROM s) GROUP BY ALL),
p AS (SELECT s.book_id, s.chapter_index, label, sum(score * weight) / any_value(w) AS average_score, max(score) AS max_score, any_value(scene_count) AS scene_count
      FROM s JOIN sw ON s.book_id = sw.book_id AND s.chapter_index = sw.chapter_index GROUP BY s.book_id, s.chapter_index, label)"""
BOOK = PROFILE + """,
b AS (SELECT book_id, label, sum(round(average_score, 6)) / (SELECT count(DISTINCT chapter_index) FROM p q WHERE q.book_id = p.book_id) AS score FROM p GROUP BY book_id, label)"""
TREND = PROFILE + """,
t AS (SELECT book_id, label, arg_min(average_score, chapter_index) AS first_score, arg_max(average_score, chapter_index) AS last_score, max(average_score) AS peak_score,
      min(CASE WHEN average_score = m THEN chapter_index END) AS peak_chapter
      FROM (SELECT *, max(average_score) OVER (PARTITION BY book_id, label) AS m FROM p) GROUP BY book_id, label)"""


def profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.chapter_profile(scores(spark, sf))


@query("chapter_profile", f"WITH {PROFILE} SELECT book_id, chapter_index, label, round((average_score) + 1e-9, 4) AS average_score, round((max_score) + 1e-9, 4) AS max_score, scene_count FROM p")
def _(spark, sf):
    return profile(spark, sf).select("book_id", "chapter_index", "label", r4("average_score").alias("average_score"), r4("max_score").alias("max_score"), "scene_count")


def _ranked(by: str, order: str, part: str, k: int, table: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {by} {order}, label) AS rank FROM {table}) WHERE rank <= {k}"


@query("chapter_top5", f"WITH {PROFILE} SELECT book_id, chapter_index, rank, label, round((average_score) + 1e-9, 4) AS score FROM ({_ranked('average_score', 'DESC', 'book_id, chapter_index', 5, 'p')})")
def _(spark, sf):
    return P.top_k(profile(spark, sf), ["book_id", "chapter_index"], 5, "average_score").select("book_id", "chapter_index", "rank", "label", r4("average_score").alias("score"))


@query("dominant_above_threshold", f"WITH {PROFILE} SELECT book_id, chapter_index, label, round((average_score) + 1e-9, 4) AS score FROM p WHERE average_score >= 0.5")
def _(spark, sf):
    return P.above_threshold(profile(spark, sf), 0.5, "average_score").select("book_id", "chapter_index", "label", r4("average_score").alias("score"))


INTENSE = "i AS (SELECT book_id, chapter_index, scene_index, coalesce(max(CASE WHEN label != 'neutral' THEN score END), 0) AS intensity FROM s GROUP BY ALL)"


@query("intense_scenes", f"WITH {BASE}, {INTENSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY intensity DESC, scene_index) AS rank FROM i) WHERE rank <= 5")
def _(spark, sf):
    return P.intense_scenes(scores(spark, sf))


@query("top_scenes_by_emotion", f"WITH {BASE} SELECT book_id, chapter_index, label, scene_index, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index, label ORDER BY score DESC, scene_index) AS rank FROM s) WHERE rank <= 3")
def _(spark, sf):
    return P.top_scenes_by_emotion(scores(spark, sf)).drop("weight")


@query("book_scores", f"WITH {BOOK} SELECT book_id, label, round((score) + 1e-9, 4) AS score FROM b")
def _(spark, sf):
    return P.book_scores(profile(spark, sf)).select("book_id", "label", r4("score").alias("score"))


@query("book_top10", f"WITH {BOOK} SELECT book_id, rank, label FROM ({_ranked('score', 'DESC', 'book_id', 10, 'b')})")
def _(spark, sf):
    return P.top_k(P.book_scores(profile(spark, sf)), ["book_id"], 10).select("book_id", "rank", "label")


@query("chapter_arc", f"WITH {PROFILE}, r AS ({_ranked('average_score', 'DESC', 'book_id, chapter_index', 5, 'p')}) SELECT r.book_id, r.chapter_index, string_agg(label, ',' ORDER BY rank) AS top, round((any_value(m)) + 1e-9, 4) AS intensity FROM r JOIN (SELECT book_id, chapter_index, max(average_score) FILTER (label != 'neutral') AS m FROM p GROUP BY ALL) USING (book_id, chapter_index) GROUP BY r.book_id, r.chapter_index")
def _(spark, sf):
    return P.chapter_arc(profile(spark, sf)).withColumn("intensity", r4("intensity"))


@query("emotion_trends", f"WITH {TREND} SELECT book_id, label, round((first_score) + 1e-9, 4) AS first_score, round((last_score) + 1e-9, 4) AS last_score, round((last_score - first_score) + 1e-9, 4) AS delta, peak_chapter, round((peak_score) + 1e-9, 4) AS peak_score FROM t")
def _(spark, sf):
    t = P.trends(profile(spark, sf))
    return t.select("book_id", "label", "peak_chapter", *[r4(c).alias(c) for c in ("first_score", "last_score", "delta", "peak_score")])


for _kind, _by, _k in (("rising", "last_score - first_score DESC", 8), ("falling", "last_score - first_score", 8), ("peaks", "peak_score DESC", 12)):
    QUERIES[f"{_kind}_emotions"] = lambda spark, sf, kind=_kind: P.ranked_trends(P.trends(profile(spark, sf)), kind).select("book_id", "rank", "label")
    SQL[f"{_kind}_emotions"] = f"WITH {TREND} SELECT book_id, label, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY {_by}, label) AS rank FROM t) WHERE rank <= {_k}"


@query("plot_labels", f"WITH {BASE}, m AS (SELECT book_id, label, sum(score) / (SELECT count(DISTINCT scene_index) FROM s q WHERE q.book_id = s.book_id) AS score FROM s WHERE label != 'neutral' GROUP BY book_id, label) SELECT book_id, rank, label FROM ({_ranked('score', 'DESC', 'book_id', 8, 'm')})")
def _(spark, sf):
    return P.plot_labels(scores(spark, sf), ["scene_index"]).select("book_id", "rank", "label")


PLOTTED = f"{PROFILE}, m AS (SELECT book_id, label, sum(average_score) / count(*) AS score FROM p WHERE label != 'neutral' GROUP BY ALL), l AS ({_ranked('score', 'DESC', 'book_id', 8, 'm')})"


@query("trajectory", f"WITH {PLOTTED} SELECT p.book_id, chapter_index, p.label, round((average_score) + 1e-9, 4) AS score FROM p JOIN l ON p.book_id = l.book_id AND p.label = l.label")
def _(spark, sf):
    return P.trajectory(profile(spark, sf)).withColumn("score", r4("score"))


@query("chapter_bars", f"WITH {PROFILE} SELECT book_id, chapter_index, rank, label FROM ({_ranked('average_score', 'DESC', 'book_id, chapter_index', 10, 'p')})")
def _(spark, sf):
    return P.top_k(profile(spark, sf), ["book_id", "chapter_index"], 10, "average_score").select("book_id", "chapter_index", "rank", "label")


@query("timeline_labels", f"WITH {PROFILE}, r AS ({_ranked('average_score', 'DESC', 'book_id, chapter_index', 3, 'p')}), f AS (SELECT book_id, label, min(chapter_index * 10 + rank) AS o FROM r GROUP BY ALL) SELECT book_id, label, row_number() OVER (PARTITION BY book_id ORDER BY o) AS position FROM f")
def _(spark, sf):
    return P.timeline_labels(profile(spark, sf))


@query("blocks", f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index, scene_index ORDER BY score DESC, label) AS r FROM s) SELECT book_id, chapter_index, scene_index, coalesce(string_agg(label, ',' ORDER BY r) FILTER (r <= 5), '') AS top, coalesce(string_agg(label, ',' ORDER BY r) FILTER (score >= 0.7), '') AS above, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, scene_index) AS block_index FROM r GROUP BY book_id, chapter_index, scene_index")
def _(spark, sf):
    return P.blocks(scores(spark, sf), 0.7).drop("scene_ref")


@query("percent_display", f"WITH {PROFILE} SELECT book_id, chapter_index, label, round(average_score * 100, 1) AS pct FROM p")
def _(spark, sf):
    return profile(spark, sf).select("book_id", "chapter_index", "label", F.round(F.col("average_score") * 100, 1).alias("pct"))


@query("calibrated_scores", f"WITH {BASE}, m AS (SELECT book_id, label, 0.35 * median(score) AS f FROM s GROUP BY ALL) SELECT s.book_id, chapter_index, scene_index, s.label, round(round(CASE WHEN s.label = 'neutral' THEN score * 0.7 WHEN f >= 0.95 THEN score ELSE least(1, greatest(0, score - f) / greatest(0.05, 1 - f)) END, 6) + 1e-9, 4) AS score FROM s JOIN m ON s.book_id = m.book_id AND s.label = m.label")
def _(spark, sf):
    return S.calibrate(scores(spark, sf)).select("book_id", "chapter_index", "scene_index", "label", r4("score").alias("score"))


@query("calibration_report", f"WITH {BASE}, m AS (SELECT book_id, label, median(score) AS m FROM s GROUP BY ALL) SELECT book_id, string_agg(printf('%s=%.4f', label, m), ',' ORDER BY label) AS baseline, (SELECT count(DISTINCT scene_index) FROM s WHERE s.book_id = m.book_id) AS scenes FROM m GROUP BY book_id")
def _(spark, sf):
    return S.calibration_report(scores(spark, sf))


CHUNKS = "c AS (SELECT book_id, chapter_index, scene_index // 3 AS scene_index, (weight * 10)::BIGINT AS words, label, score FROM s)"


@query("chunk_blend", f"WITH {BASE}, {CHUNKS} SELECT book_id, chapter_index, scene_index, label, round((CASE WHEN label = 'neutral' THEN sum(score * words) / sum(words) ELSE 0.7 * sum(score * words) / sum(words) + 0.3 * max(score) END) + 1e-9, 4) AS score FROM c GROUP BY book_id, chapter_index, scene_index, label")
def _(spark, sf):
    c = scores(spark, sf).withColumn("scene_index", F.floor(F.col("scene_index") / 3)).withColumn("words", (F.col("weight") * 10).cast("long"))
    return S.combine_chunks(c, ["book_id", "chapter_index", "scene_index"]).withColumn("score", r4("score"))


def score_maps(spark, sf):
    """A row per scene with a map of scores, of the labels that the correction knows."""
    names = ["neutral", "approval", "joy", "sadness", "fear", "remorse", "caring", "love"]
    e = read(spark, sf, "embeddings")
    value = F.transform(F.slice("embedding", 1, 8), lambda x: F.round(1 / (1 + F.exp(-8 * x.cast("double"))), 6))
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), value)
    v = F.col("vec_id")
    return e.select(
        "vec_id", m.alias("scores"), (v % 1500).alias("words"), F.when(v % 5 == 0, "compassion").otherwise("unclear").alias("meaning"),
        F.when(v % 4 == 0, F.array(F.lit("tragic"))).otherwise(F.array().cast("array<string>")).alias("tones"), (v % 7 == 0).alias("direct"),
    )


MAPS = "m AS (SELECT vec_id, vec_id % 1500 AS words, vec_id % 5 = 0 AS moral, vec_id % 4 = 0 AS tragic, vec_id % 7 = 0 AS direct, " + ", ".join(f"round(1 / (1 + exp(-8 * embedding[{k + 1}]::DOUBLE)), 6) AS {n}" for k, n in enumerate("neutral approval joy sadness fear remorse caring love".split())) + " FROM embeddings)"


@query("corrected_scores", f"""WITH {MAPS}, d AS (SELECT *, approval > 0 AND NOT direct AND (moral OR tragic OR sadness >= 0.65 * approval OR fear >= 0.55 * approval OR remorse >= 0.45 * approval) AS damp FROM m),
x AS (SELECT *, CASE WHEN damp THEN least(1, sadness + 0.12 * approval) ELSE sadness END AS sad FROM d)
SELECT vec_id, round((CASE WHEN damp THEN approval * 0.55 ELSE approval END) + 1e-9, 4) AS approval, round((CASE WHEN damp THEN least(1, caring + 0.22 * approval) ELSE caring END) + 1e-9, 4) AS caring, round((sad) + 1e-9, 4) AS sadness,
round((CASE WHEN damp THEN least(1, love + 0.06 * approval) ELSE love END) + 1e-9, 4) AS love, round((CASE WHEN approval > 0 AND NOT direct AND joy > 0 AND (tragic OR sad > joy) THEN joy * 0.75 ELSE joy END) + 1e-9, 4) AS joy FROM x""")
def _(spark, sf):
    m = score_maps(spark, sf)
    fixed = S.correct(F.col("scores"), F.col("meaning"), F.col("tones"), F.col("direct"), F.lit(True))
    return m.withColumn("f", fixed).select("vec_id", *[r4(F.col("f")[k]).alias(k) for k in ("approval", "caring", "sadness", "love", "joy")])


TOP2 = "list_reverse_sort([approval, joy, sadness, fear, remorse, caring, love])"
CONF = f"least(1, greatest(0.05, 0.62::DOUBLE + CASE WHEN words < 80 THEN -0.18 WHEN words > 1200 THEN -0.08 ELSE 0 END + CASE WHEN {TOP2}[1] - {TOP2}[2] < 0.025 THEN -0.12 WHEN {TOP2}[1] - {TOP2}[2] > 0.12 THEN 0.08 ELSE 0 END))"


@query("scene_confidence", f"WITH {MAPS} SELECT vec_id, round(({CONF}) + 1e-9, 4) AS confidence, round(greatest(words, 1) * (0.75 + least(0.75, 2 * {TOP2}[1])) * (0.5 + {CONF}), 3) AS weight FROM m")
def _(spark, sf):
    m = score_maps(spark, sf).withColumn("confidence", S.confidence(F.col("words"), F.col("scores")))
    w = S.scene_weight(F.col("words"), F.col("scores"), F.col("confidence"))
    return m.select("vec_id", r4("confidence").alias("confidence"), F.round(w, 3).alias("weight"))


@query("average_confidence", f"WITH {MAPS} SELECT round((avg({CONF})) + 1e-9, 4) AS confidence FROM m")
def _(spark, sf):
    return score_maps(spark, sf).agg(r4(F.avg(S.confidence(F.col("words"), F.col("scores")))).alias("confidence"))


@query("perspective_scores", f"WITH {MAPS} SELECT vec_id, round(round(joy * CASE WHEN tragic THEN 0.35 ELSE 0.75 END, 6) + 1e-9, 4) AS narrator_joy, round(round(joy * CASE WHEN tragic THEN 0.75 ELSE 0.35 END, 6) + 1e-9, 4) AS character_joy FROM m")
def _(spark, sf):
    m = score_maps(spark, sf)
    none = F.array().cast("array<string>")
    p = S.perspective(F.col("scores"), none, none, F.when(F.size("tones") > 0, "dialogue").otherwise("narrator"))
    return m.withColumn("p", p).select("vec_id", r4(F.col("p.narrator")["joy"]).alias("narrator_joy"), r4(F.col("p.character")["joy"]).alias("character_joy"))


# --- lines of documents: book = source, page = doc_id


def lines(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("source", "doc_id", F.size(F.split("text", "\n")).alias("n"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    y = 30.0 + 18.0 * F.col("line_no")
    return d.select(
        F.col("source").alias("book_id"), F.col("doc_id").alias("page_num"), "line_no", T.clean_line("text").alias("text"), F.lit(50.0).alias("x0"), F.lit(550.0).alias("x1"),
        y.alias("y0"), (y + 12).alias("y1"), F.lit(12.0).alias("font_size"), F.lit(600.0).alias("page_width"), (18.0 * F.col("n") + 60).alias("page_height"),
    ).where("text != ''")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page, those without a line too."""
    return read(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("page_num"))


CLEAN = r"trim(regexp_replace(replace(replace(x, chr(160), ' '), chr(173), ''), '\s+', ' ', 'g'))"
LINES = f"""
raw AS (SELECT source AS book_id, doc_id AS page_num, string_split(text, chr(10)) AS parts FROM documents),
ex AS (SELECT book_id, page_num, len(parts) AS n, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS x FROM raw),
l AS (SELECT book_id, page_num, line_no, n, {CLEAN} AS text, 30.0 + 18.0 * line_no AS y0, 42.0 + 18.0 * line_no AS y1, 18.0 * n + 60 AS h FROM ex WHERE {CLEAN} != '')"""
KEY = r"regexp_replace(regexp_replace(lower(text), '^[ \-—–_]+', ''), '[ \-—–_]+$', '')"
EDGES = f"""{LINES},
k AS (SELECT *, {KEY} AS norm FROM l), pg AS (SELECT source AS book_id, count(*) AS pages FROM documents GROUP BY 1),
c AS (SELECT book_id, norm, count(DISTINCT page_num) AS n_pages, bool_or(regexp_matches(norm, '(?i)\\b[a-z0-9.-]+\\.(com|net|org|ru|io|co)\\b')) AS domain FROM k
      WHERE norm != '' AND (y0 < 0.15 * h OR y1 > 0.85 * h OR regexp_matches(norm, '(?i)\\b[a-z0-9.-]+\\.(com|net|org|ru|io|co)\\b')) GROUP BY ALL),
rep AS (SELECT c.book_id, norm, n_pages FROM c JOIN pg USING (book_id) WHERE domain OR (n_pages >= greatest(3, ceil(0.05 * pages)) AND length(norm) <= 80))"""


@query("clean_lines", f"WITH {LINES} SELECT page_num, line_no, text FROM l")
def _(spark, sf):
    return lines(spark, sf).select("page_num", "line_no", "text")


@query("word_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_''-]*'))::BIGINT AS words FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.count_words("text").alias("words"))


CAPS = r"len(regexp_extract_all(text, '\p{L}')) > 0 AND len(regexp_extract_all(text, '\p{Lu}')) >= 0.8 * len(regexp_extract_all(text, '\p{L}'))"
TITLE = r"len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '^[^\p{L}\p{N}]*\p{Lu}'))) >= 0.7 * len(w)"


@query("line_flags", f"""WITH {LINES}, f AS (SELECT *, list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '[A-Za-z]')) AS w FROM l)
SELECT page_num, line_no, {CAPS} AS caps, {TITLE} AS title_case, regexp_matches(text, '(?i)^(?:(?:page\\s+)?\\d{{1,4}}|(?:page\\s+)?\\d{{1,4}}\\s+(?:of|/)\\s+\\d{{1,4}}|[ivxlcdm]+)$') AS page_number,
regexp_matches(trim(regexp_replace(text, '[.)]+$', '')), '(?i)^(?:\\d{{1,3}}|[ivxlcdm]+)$') AS numeric,
length(text) >= 80 OR (len(string_split(text, ' ')) >= 14 AND regexp_matches(text, '[.,;:?!"]$')) AS body FROM f""")
def _(spark, sf):
    t = "text"
    flags = {"caps": T.is_all_caps, "title_case": T.is_title_case, "page_number": T.is_page_number, "numeric": T.is_numeric_only, "body": T.is_body_like}
    return lines(spark, sf).select("page_num", "line_no", *[f(t, clean=True).alias(k) for k, f in flags.items()])


@query("excerpts", f"WITH {LINES} SELECT page_num, line_no, CASE WHEN length(text) <= 60 THEN text ELSE rtrim(regexp_replace(substr(text, 1, 60), ' [^ ]*$', '')) || '...' END AS excerpt FROM l")
def _(spark, sf):
    return lines(spark, sf).select("page_num", "line_no", T.excerpt("text", 60, clean=True).alias("excerpt"))


@query("language_script", r"SELECT doc_id, CASE WHEN len(regexp_extract_all(substr(text, 1, 2000), '\p{L}')) > 0 AND len(regexp_extract_all(substr(text, 1, 2000), '[À-ÿ]')) > 0.05 * len(regexp_extract_all(substr(text, 1, 2000), '\p{L}')) THEN 'accented' ELSE 'plain' END AS script FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.detect_language("text", script="[À-ÿ]", label="accented", other="plain", share=0.05).alias("script"))


WORDS_OF = "list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '[A-Za-z]'))"
TITLED = TITLE.replace("(w)", f"({WORDS_OF})").replace("list_filter(w,", f"list_filter({WORDS_OF},").replace("* len(w)", f"* len({WORDS_OF})")
NUMERIC = r"regexp_matches(trim(regexp_replace(text, '[.)]+$', '')), '(?i)^(?:\d{1,3}|[ivxlcdm]+)$')"
NUMBER = r"regexp_matches(text, '(?i)^(?:(?:page\s+)?\d{1,4}|(?:page\s+)?\d{1,4}\s+(?:of|/)\s+\d{1,4}|[ivxlcdm]+)$')"
BODY = "(length(text) >= 80 OR (len(string_split(text, ' ')) >= 14 AND regexp_matches(text, '[.,;:?!\"]$')))"
COUNTED = r"len(regexp_extract_all(text, '[\p{L}\p{N}_][\p{L}\p{N}_''-]*'))"
QUOTED = lambda p: p.replace("'", "''")
STRUCT = f"(regexp_matches(text, '{QUOTED(T.STRUCTURED)}') OR regexp_matches(text, '{QUOTED(T.DASHED)}'))"
MATTER = lambda words: f"(regexp_matches(text, '(?i)^(?:{QUOTED(words)})\\b') AND ({COUNTED} <= 4 OR ({CAPS}) OR ({TITLED})))"
FRONT, BACK = MATTER(T.FRONT_WORDS), MATTER(T.BACK_WORDS)
SECTIONED = f"regexp_matches(text, '{QUOTED(T.SECTION)}')"
BAD = f"regexp_matches(lower(text), '^(?:{'|'.join(T.BAD_PREFIXES)})')"
HEADING = f"""(length(text) > 0 AND length(text) <= 120 AND len(string_split(text, ' ')) <= 16 AND NOT {BAD}
    AND NOT (regexp_matches(text, '[.?!;]$') AND NOT {STRUCT} AND NOT {NUMERIC} AND len(string_split(text, ' ')) > 8 AND NOT ({CAPS}))
    AND ({NUMERIC} OR {STRUCT} OR {FRONT} OR {BACK} OR {SECTIONED} OR ({CAPS}) OR ({TITLED})))"""


@query("heading_lines", f"WITH {LINES} SELECT page_num, line_no, CASE WHEN {FRONT} THEN 'front' WHEN {BACK} THEN 'back' ELSE 'chapter' END AS kind FROM l WHERE {HEADING}")
def _(spark, sf):
    marked = L.settled(lines(spark, sf), {"heading": T.is_heading_line("text", clean=True), "kind": T.candidate_kind("text", clean=True)})
    return marked.where("heading").select("page_num", "line_no", "kind")


MARKED = f"""{EDGES},
f AS (SELECT k.*, rep.norm IS NOT NULL AS repeat, {NUMBER} AS number, {NUMERIC} AS numeric, {HEADING} AS heading, {BODY} AS body, len(string_split(text, ' ')) >= 6 AND NOT {NUMBER} AS worded
      FROM k LEFT JOIN rep ON k.book_id = rep.book_id AND k.norm = rep.norm),
g AS (SELECT *, coalesce(lead(heading) OVER w, false) AS nh, coalesce(lead(heading OR body OR worded) OVER w, false) AS nt FROM f WINDOW w AS (PARTITION BY book_id, page_num ORDER BY line_no)),
marked AS (SELECT *, repeat OR (number AND (y0 < 0.15 * h OR y1 > 0.85 * h) AND NOT (y0 < 0.25 * h AND nh AND length(text) <= 4)) AS removed FROM g)"""


@query("repeated_headers", f"WITH {EDGES} SELECT * FROM rep")
def _(spark, sf):
    return L.repeated_edges(lines(spark, sf), pages(spark, sf))


@query("lines_without_headers", f"WITH {MARKED} SELECT book_id, page_num, line_no, text FROM marked WHERE NOT removed")
def _(spark, sf):
    return L.without_edges(lines(spark, sf), pages(spark, sf)).select("book_id", "page_num", "line_no", "text")


@query("removed_preview", f"""WITH {MARKED}, n AS (SELECT book_id, text, count(*) AS n, min(page_num * 100000 + line_no) AS first FROM marked WHERE removed GROUP BY ALL)
SELECT book_id, rank, text || ' (x' || n || ')' AS preview FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, first) AS rank FROM n) WHERE rank <= 10""")
def _(spark, sf):
    return L.removed_preview(lines(spark, sf), 10, pages(spark, sf))


@query("page_medians", f"WITH {LINES}, w AS (SELECT *, lead(y0) OVER (PARTITION BY book_id, page_num ORDER BY line_no) - y1 AS d FROM l), g AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(0, d) END AS gap FROM w) SELECT book_id, page_num, 12.0::DOUBLE AS median_font, coalesce(median(gap), 8.0)::DOUBLE AS median_gap FROM g GROUP BY ALL")
def _(spark, sf):
    return L.page_medians(lines(spark, sf))


@query("line_gaps", f"WITH {LINES} SELECT page_num, line_no, coalesce(CASE WHEN lag(y1) OVER w IS NOT NULL THEN greatest(0, y0 - lag(y1) OVER w) END, y0)::DOUBLE AS gap_before, coalesce(CASE WHEN lead(y0) OVER w IS NOT NULL THEN greatest(0, lead(y0) OVER w - y1) END, h - y1)::DOUBLE AS gap_after FROM l WINDOW w AS (PARTITION BY book_id, page_num ORDER BY line_no)")
def _(spark, sf):
    return L.with_gaps(lines(spark, sf)).select("page_num", "line_no", "gap_before", "gap_after")


@query("line_index", f"WITH {LINES} SELECT page_num, line_no, row_number() OVER (PARTITION BY book_id ORDER BY page_num, line_no) - 1 AS global_index FROM l")
def _(spark, sf):
    return L.with_index(lines(spark, sf)).select("page_num", "line_no", F.col("global_index").cast("long").alias("global_index"))


@query("rebuilt_paragraphs", f"""WITH {LINES}, f AS (SELECT *, CASE WHEN lag(page_num) OVER w IS DISTINCT FROM page_num OR y0 - lag(y1) OVER w > greatest(8, 0.012 * h) THEN 1 ELSE 0 END AS nw FROM l WINDOW w AS (PARTITION BY book_id ORDER BY page_num, line_no)),
q AS (SELECT *, sum(nw) OVER (PARTITION BY book_id ORDER BY page_num, line_no) AS paragraph FROM f)
SELECT book_id, paragraph::BIGINT AS paragraph, regexp_replace(string_agg(text, ' ' ORDER BY page_num, line_no), '- (\\p{{Ll}})', '\\1', 'g') AS text FROM q GROUP BY ALL""")
def _(spark, sf):
    return L.paragraphs(lines(spark, sf))


TXT_LINES = """
tr AS (SELECT doc_id, string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
tl AS (SELECT doc_id, len(parts) AS n, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS x FROM tr)"""


@query("txt_geometry", f"WITH {TXT_LINES} SELECT doc_id AS book_id, count(*) AS lines, max(42.0 + 18.0 * line_no)::DOUBLE AS bottom, max(greatest(800, 14.0 * n + 40))::DOUBLE AS page_height FROM tl WHERE {CLEAN} != '' GROUP BY doc_id")
def _(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), "text")
    return L.txt_lines(d).groupBy("book_id").agg(F.count("*").alias("lines"), F.max("y1").alias("bottom"), F.max("page_height").alias("page_height"))


def doc_lines(spark, sf):
    """Each document as a TXT book of its own."""
    return L.txt_lines(read(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), "text"))


@query("heading_candidates")
def _(spark, sf):
    return H.resolved(H.candidates(doc_lines(spark, sf))).select("book_id", "start_global", "end_global", "title", "kind", "score")


@query("detected_chapters")
def _(spark, sf):
    return H.detect(doc_lines(spark, sf)).chapters.select("book_id", "chapter_index", "chapter_title", F.length("text").alias("chars"), "start_page", "end_page")


@query("detection_counts")
def _(spark, sf):
    return H.resolved(H.candidates(doc_lines(spark, sf))).groupBy("kind").agg(F.count("*").alias("candidates"), F.count_distinct("book_id").alias("books"))


def chapters(spark, sf):
    """book = source, chapter = rank of doc_id, paragraphs = lines."""
    d = read(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return d


@query("paragraphs", f"SELECT chapter_index, (row_number() OVER (PARTITION BY chapter_index ORDER BY i) - 1)::BIGINT AS pos, x AS text FROM (SELECT doc_id AS chapter_index, unnest(range(0, len(string_split(text, chr(10))))) AS i, trim(regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g')) AS x FROM documents) WHERE x != ''")
def _(spark, sf):
    return chapters(spark, sf).select("chapter_index", F.posexplode(G.split_paragraphs("text")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


@query("scenes")
def _(spark, sf):
    s = G.scenes(chapters(spark, sf), 50, 120)
    return s.select("chapter_index", "scene_index", T.count_words("text").alias("words"), "start_char", "end_char", "scene_pos")


@query("scene_chunks")
def _(spark, sf):
    c = G.chunks(G.scenes(chapters(spark, sf)), 128, 16)
    return c.select("chapter_index", "scene_index", "chunk_index", F.size(F.split("text", r"\s+")).alias("tokens"))


@query("sentence_chunks")
def _(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(G.sentence_chunks("text", 400)).alias("pos", "text"))


@query("translated_roundtrip", "SELECT doc_id AS book_id, text FROM (SELECT doc_id, lower(array_to_string(list_filter(string_split_regex(replace(text, chr(10), ' '), ' +'), lambda x: x != ''), ' ')) AS text FROM documents)")
def _(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), F.trim(F.regexp_replace("text", r"[\n ]+", " ")).alias("text"))
    return G.translated(d, lambda xs: [x.lower() for x in xs])


LEX = {"joy": r"\bthe\b", "fear": r"\bque\b", "anger": r"\b(der|die)\b"}


@query("lexical_cues", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])') THEN 'joy' END, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])que($|[^\p{L}\p{N}_])') THEN 'fear' END, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(der|die)($|[^\p{L}\p{N}_])') THEN 'anger' END], lambda x: x IS NOT NULL), ',') AS cues FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(C.cues(F.col("text"), LEX), ",").alias("cues"))


@query("lexicon_scores", r"SELECT doc_id, round((n / (n + 2.0)) + 1e-9, 4) AS joy FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '\bthe\b'))::DOUBLE AS n FROM documents)")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", r4(S.lexicon_scores(F.col("text"), LEX)["joy"]).alias("joy"))


@query("character_names")
def _(spark, sf):
    return C.names(read(spark, sf, "documents"), ["doc_id"])


def turns(spark, sf):
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("scene_pos"), "role", "text")


@query("scene_neighbours", "SELECT conv_id AS book_id, turn AS scene_pos, lag(length(text)) OVER w AS previous_chars, lead(length(text)) OVER w AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, length(text))")
def _(spark, sf):
    t = turns(spark, sf).withColumn("chars", F.length("text").cast("long")).drop("text", "role")
    return S.with_neighbours(t, ["chars"]).select("book_id", "scene_pos", "previous_chars", "next_chars")


@query("scene_context", r"""SELECT conv_id AS book_id, turn AS scene_pos, CASE WHEN q >= 4 THEN 'dialogue' ELSE 'narrator' END AS dominant_perspective, round(least(0.75, 0.45::DOUBLE + CASE WHEN tones > 0 THEN 0.15 ELSE 0 END + CASE WHEN q > 0 THEN 0.05 ELSE 0 END + CASE WHEN n > 1 THEN 0.05 ELSE 0 END), 2) AS confidence
FROM (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '["'']')) AS q, count(*) OVER (PARTITION BY conv_id) AS n, regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the($|[^\p{L}\p{N}_])')::INT + regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])que($|[^\p{L}\p{N}_])')::INT + regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(der|die)($|[^\p{L}\p{N}_])')::INT AS tones FROM conversations)""")
def _(spark, sf):
    return C.heuristic(turns(spark, sf), LEX).select("book_id", "scene_pos", "dominant_perspective", F.round("confidence", 2).alias("confidence"))


@query("character_profiles", f"WITH {BASE}, v AS (SELECT book_id, 'N' || chapter_index AS name, scene_index AS scene_pos, label, greatest(1, floor(score * 10 + 0.5)) AS votes FROM s WHERE score >= 0.6), t AS (SELECT book_id, name, sum(votes) AS a, count(DISTINCT scene_pos) AS mentions FROM v GROUP BY ALL), q AS (SELECT book_id, name, label, any_value(mentions) AS mentions, sum(votes) / any_value(a) AS score FROM v JOIN t USING (book_id, name) GROUP BY ALL) SELECT book_id, name, label, mentions, round((score) + 1e-9, 4) AS score, rank FROM ({_ranked('score', 'DESC', 'book_id, name', 8, 'q')}) WHERE label != 'neutral'")
def _(spark, sf):
    s = scores(spark, sf).where("score >= 0.6")
    v = s.select("book_id", F.concat(F.lit("N"), F.col("chapter_index").cast("string")).alias("name"), F.col("scene_index").alias("scene_pos"), "label", F.greatest(F.lit(1.0), F.floor(F.col("score") * 10 + 0.5)).alias("votes"))
    return P.character_profiles(v).withColumn("score", r4("score"))


@query("short_chapters_dropped", """WITH c AS (SELECT source AS book_id, doc_id, length(text) >= 100 AS long, bool_or(coalesce(length(text) < 100, true)) OVER (PARTITION BY source) AS lost FROM documents)
SELECT book_id, doc_id AS source_chapter_index, CASE WHEN lost THEN row_number() OVER (PARTITION BY book_id ORDER BY doc_id) ELSE doc_id END AS chapter_index FROM c WHERE long""")
def _(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), "text")
    return P.drop_short_chapters(d).select("book_id", "source_chapter_index", F.col("chapter_index").cast("long").alias("chapter_index"))


@query("result_json_roundtrip", f"WITH {PROFILE} SELECT book_id::VARCHAR AS job_id, chapter_index, label, round(round(average_score, 6) + 1e-9, 4) AS score FROM p")
def _(spark, sf):
    docs = K.result_documents(profile(spark, sf)).withColumn("job_id", F.col("book_id").cast("string"))
    back = B.chapters_of(docs).select("job_id", F.col("chapter_index").cast("long").alias("chapter_index"), F.explode("scores").alias("label", "score"))
    return back.withColumn("score", r4("score"))


@query("wide_chapters", f"WITH {PROFILE} SELECT book_id, chapter_index, arg_min(label, (-average_score, label)) AS top_1, round((max(average_score)) + 1e-9, 4) AS top_1_score, " + ", ".join(f"round((max(average_score) FILTER (label = '{x}')) + 1e-9, 4) AS \"{x}\"" for x in sorted(LABELS)) + " FROM p GROUP BY ALL")
def _(spark, sf):
    w = K.wide(profile(spark, sf), ["book_id", "chapter_index"], LABELS, "average_score")
    return w.select("book_id", "chapter_index", "top_1", r4("top_1_score").alias("top_1_score"), *[r4(x).alias(x) for x in sorted(LABELS)])


@query("summary_lines")
def _(spark, sf):
    return K.summary(profile(spark, sf))


# --- jobs: events as status events, orders as texts


def job_events(spark, sf):
    e = read(spark, sf, "events")
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type").isin("view", "click"), "processing").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    return e.select(F.floor(F.col("event_id") / 4).alias("job_id"), F.col("ts").alias("updated_at"), status.alias("status"), "user_id", F.lit(None).cast("string").alias("error"))


EVENTS = "ev AS (SELECT event_id // 4 AS job_id, ts AS updated_at, CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type IN ('view', 'click') THEN 'processing' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status, user_id FROM events)"
LATEST = f"{EVENTS}, la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END DESC, status DESC, user_id DESC) AS r FROM ev) WHERE r = 1)"


@query("jobs_latest", f"WITH {LATEST} SELECT job_id, status, user_id FROM la")
def _(spark, sf):
    return J.latest(job_events(spark, sf)).select("job_id", "status", "user_id")


@query("job_status_counts", f"WITH {LATEST} SELECT status, count(*) AS jobs FROM la GROUP BY status")
def _(spark, sf):
    return J.status_counts(J.latest(job_events(spark, sf)))


def texts(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("text_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))


@query("texts_page", "SELECT text_id, user_id, place, total FROM (SELECT o_orderkey AS text_id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE place > 2 AND place <= 7")
def _(spark, sf):
    return J.texts_page(texts(spark, sf), 5, 2).select("text_id", "user_id", "place", "total")


@query("user_jobs", f"WITH {LATEST} SELECT job_id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, job_id DESC) AS place FROM la JOIN orders ON o_orderkey = job_id")
def _(spark, sf):
    jobs = J.latest(job_events(spark, sf)).select("job_id", F.col("job_id").alias("text_id"), "status")
    return J.user_jobs(jobs, texts(spark, sf)).select("job_id", "user_id", "place")


@query("job_results", f"WITH {LATEST}, q AS (SELECT DISTINCT job_id + job_id % 3 * 1000000 AS job_id, 0 AS z FROM la) SELECT q.job_id, CASE WHEN la.user_id IS NULL THEN 'not found' WHEN status != 'completed' THEN 'not complete' WHEN q.job_id % 2 = 1 THEN 'not found' ELSE 'ok' END AS outcome FROM q LEFT JOIN la ON q.job_id = la.job_id")
def _(spark, sf):
    jobs = J.latest(job_events(spark, sf))
    asked = jobs.select((F.col("job_id") + F.col("job_id") % 3 * 1000000).alias("job_id")).distinct()
    asked = asked.join(jobs.select("job_id", F.col("user_id").alias("asked_by")), "job_id", "left")
    results = jobs.where("job_id % 2 = 0").select("job_id")
    return J.job_results(asked, jobs, results).select("job_id", "outcome")


@query("delete_cascade", "SELECT 'text' AS kind, o_orderkey AS id FROM orders WHERE o_custkey % 10 != 0 UNION ALL SELECT 'result', o_orderkey FROM orders WHERE o_custkey % 10 != 0 AND o_orderkey % 3 = 0")
def _(spark, sf):
    t = texts(spark, sf)
    results = t.where("text_id % 3 = 0").select("text_id")
    kept, left = J.delete_texts(t, results, t.where("user_id % 10 = 0").select("text_id"))
    return kept.select(F.lit("text").alias("kind"), F.col("text_id").alias("id")).unionByName(left.select(F.lit("result").alias("kind"), F.col("text_id").alias("id")))


@query("overdue_jobs", f"WITH {LATEST}, z AS (SELECT max(updated_at) AS now FROM ev) SELECT job_id, CASE WHEN status = 'processing' AND date_diff('second', updated_at, now) > 14400 THEN 'failed' ELSE status END AS status FROM la, z")
def _(spark, sf):
    jobs = J.latest(job_events(spark, sf))
    now = job_events(spark, sf).agg(F.max("updated_at").alias("now"))
    return J.overdue(jobs.withColumn("now", now.scalar()), F.col("now")).select("job_id", "status")


@query("results_appended", "SELECT DISTINCT event_id // 4 AS job_id FROM events WHERE event_id // 4 % 3 != 0")
def _(spark, sf):
    jobs = J.latest(job_events(spark, sf)).select("job_id")
    return J.append_new(jobs.where("job_id % 3 = 0"), jobs.withColumn("result_json", F.lit("{}"))).select("job_id")


@query("page_formats", r"SELECT page_id, lower(regexp_extract(url, '\.([^.\\/]*)$', 1)) AS format FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.detect_format("url").alias("format"))

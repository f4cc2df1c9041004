"""Queries of streams, plug-ins, stored names and rows that are odd: null books and texts,
names with apostrophes, headings of several kinds. All over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import headings as H
from ..operators import layout as L
from ..operators import profiles as P
from ..operators import scoring as S
from ..operators import segment as G
from ..operators.cut import shared_path
from ..sources import sinks
from ..streaming import jobs as J
from ..streaming import queue as Q
from ..streaming import status
from .queries import BASE, EVENTS, job_events, scores, turns
from .registry import query, r4, read

# --- streams


def events_folder(spark: SparkSession, sf: str) -> str:
    """The job events as files that a stream reads."""
    path = shared_path(spark, "events")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("text_id", "title", "error")]
    rows = job_events(spark, sf).select(F.col("job_id").cast("string").alias("job_id"), "status", "updated_at", F.col("user_id").cast("string").alias("user_id"), *nothing)
    rows.write.parquet(path)
    return path


#: The latest event of a job, and the time limit by the watermark: an hour behind the latest event.
STREAMED = f"""WITH {EVENTS}, la AS (SELECT DISTINCT ON (job_id) job_id, status, updated_at FROM ev ORDER BY job_id, updated_at DESC, CASE status WHEN 'pending' THEN 0 WHEN 'processing' THEN 1 ELSE 2 END DESC, status DESC),
z AS (SELECT max(epoch_ms(updated_at)) - 3600000 AS now FROM ev), o AS (SELECT *, status = 'processing' AND epoch_ms(updated_at) + 14400000 <= now AS late FROM la, z)"""


@query("stream_status", f"{STREAMED} SELECT job_id::VARCHAR AS job_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN 'job exceeded 14400s timeout' END AS error FROM o")
def _(spark, sf):
    session, checkpoint = status.stateful(spark), shared_path(spark, "status")
    events = session.readStream.schema(J.EVENTS).parquet(events_folder(spark, sf))
    J.current_status(events, shared_path(spark, "log"), checkpoint, clock="EventTime", delay="1 hour").awaitTermination()
    return status.current(spark, checkpoint).select("job_id", "status", "error")


@query("stream_results", "SELECT DISTINCT (event_id // 4)::VARCHAR AS job_id, 'ORDER ' || (event_id // 4) AS result_json FROM events WHERE event_type = 'signup' AND event_id // 4 IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    texts = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("text_id"), F.concat(F.lit("order "), "o_orderkey").alias("content"))
    path, out = events_folder(spark, sf), shared_path(spark, "results")
    spark.read.parquet(path).withColumn("text_id", F.col("job_id")).write.parquet(f"{path}-t")
    for k in range(2):  # a second stream over the same events adds nothing
        stream = J.job_stream(spark, f"{path}-t", texts, delay="365 days")
        J.analyse(stream, lambda b: b.select("job_id", F.upper("content").alias("result_json")), out, shared_path(spark, f"c{k}")).awaitTermination()
    return J.finished(spark, out)


@query("queued_jobs", "SELECT o_orderkey::VARCHAR AS job_id, 'USER ' || o_custkey AS result_json FROM orders")
def _(spark, sf):
    # the queue is files that Python opens: its folder must be one that all executors mount
    folder = shared_path(spark, "queue").removeprefix("file://")
    if "://" in folder:
        raise ValueError("the job queue needs a mounted folder")
    spark.dataSource.register(Q.JobQueue)
    key = F.col("o_orderkey").cast("string")
    jobs = read(spark, sf, "orders").select(key.alias("job_id"), F.col("o_custkey").cast("string").alias("text_id"), F.lit(None).cast("string").alias("user_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("submitted_at"))
    jobs.write.format("jobqueue").options(path=folder, lanes=6).mode("append").save()
    texts = jobs.select("text_id", F.concat(F.lit("user "), "text_id").alias("content")).distinct()
    out = shared_path(spark, "results")
    for member in range(2):
        J.analyse(J.claimed(spark, folder, texts, member, 2), lambda b: b.select("job_id", F.upper("content").alias("result_json")), out, shared_path(spark, f"m{member}")).awaitTermination()
    return J.finished(spark, out)


# --- rows without a book or a text

NULL_BOOK = f"{BASE}, t AS (SELECT nullif(book_id, 2)::VARCHAR AS book_id, chapter_index, scene_index, label, score, weight FROM s), m AS (SELECT book_id, label, median(score) AS m FROM t GROUP BY ALL)"


def null_book(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).withColumn("book_id", F.nullif("book_id", F.lit(2).cast("long")).cast("string"))


@query("calibrated_null_book", f"WITH {NULL_BOOK} SELECT t.book_id, chapter_index, scene_index, t.label, round(round(CASE WHEN t.label = 'neutral' THEN score * 0.7 WHEN 0.35 * m >= 0.95 THEN score ELSE least(1, greatest(0, score - 0.35 * m) / greatest(0.05, 1 - 0.35 * m)) END, 6) + 1e-9, 4) AS score FROM t JOIN m ON t.book_id IS NOT DISTINCT FROM m.book_id AND t.label = m.label")
def _(spark, sf):
    return S.calibrate(null_book(spark, sf)).select("book_id", "chapter_index", "scene_index", "label", r4("score").alias("score"))


@query("report_null_book", f"WITH {NULL_BOOK} SELECT book_id, string_agg(printf('%s=%.4f', label, m), ',' ORDER BY label) AS baseline, (SELECT count(DISTINCT scene_index) FROM t WHERE t.book_id IS NOT DISTINCT FROM m.book_id) AS scenes FROM m GROUP BY book_id")
def _(spark, sf):
    return S.calibration_report(null_book(spark, sf))


@query("arc_null_book", f"WITH {NULL_BOOK}, p AS (SELECT book_id, chapter_index, label, sum(score * weight) / sum(weight) AS a FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_index ORDER BY a DESC, label) AS k FROM p) SELECT book_id, chapter_index, string_agg(label, ',' ORDER BY k) FILTER (WHERE k <= 5) AS top, round(max(a) FILTER (WHERE label != 'neutral') + 1e-9, 4) AS intensity FROM r GROUP BY ALL")
def _(spark, sf):
    arc = P.chapter_arc(P.chapter_profile(null_book(spark, sf)))
    return arc.select("book_id", "chapter_index", "top", r4("intensity").alias("intensity"))


@query("routed_books", "SELECT doc_id AS book_id, md5(CASE WHEN doc_id % 5 = 1 THEN '' WHEN doc_id % 5 = 2 THEN lower(t) ELSE t END) AS text_md5, CASE WHEN doc_id % 5 = 2 THEN 'ru' ELSE 'en' END AS source_language, doc_id % 5 = 2 AS translated FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'ДА НЕТ' ELSE coalesce(text, '') END AS t FROM documents)")
def _(spark, sf):
    part = F.col("doc_id") % 5
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), F.when(part == 2, "ДА НЕТ").when(part != 1, F.coalesce("text", F.lit(""))).alias("text"))
    routed = G.routed(d, lambda xs: [x.lower() for x in xs])
    return routed.select("book_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "source_language", "translated")


# --- names, replies, plug-ins


@query("object_names", r"SELECT doc_id, 'chapter_' || CASE WHEN doc_id + 900 < 1000 THEN lpad((doc_id + 900)::VARCHAR, 3, '0') ELSE (doc_id + 900)::VARCHAR END || '_' || regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g') AS chapter_name, 'block_' || CASE WHEN doc_id < 1000 THEN lpad(doc_id::VARCHAR, 3, '0') ELSE doc_id::VARCHAR END || '_chapter_' || CASE WHEN doc_id + 900 < 1000 THEN lpad((doc_id + 900)::VARCHAR, 3, '0') ELSE (doc_id + 900)::VARCHAR END || '_scene_' || lpad((doc_id % 7)::VARCHAR, 3, '0') AS block_name FROM documents")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") + 900).alias("chapter_index"), F.col("source").alias("chapter_title"))
    named = sinks.text_names(d).withColumnsRenamed({"name": "chapter_name"})
    blocks = sinks.text_names(named.withColumns({"scene_index": F.col("doc_id") % 7, "scene_pos": F.col("doc_id")}))
    return blocks.select("doc_id", "chapter_name", F.col("name").alias("block_name"))


@query("reply_kinds", """WITH q AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT conv_id AS book_id, turn AS scene_pos,
CASE turn % 5 WHEN 1 THEN 'last' WHEN 4 THEN '5' ELSE '' END AS summary, CASE turn % 5 WHEN 0 THEN 'O''Brien ' || conv_id || '=joy' WHEN 1 THEN 'A=fear' ELSE '' END AS people,
CASE turn % 5 WHEN 0 THEN 'O''Brien ' || conv_id || '=joy' WHEN 1 THEN 'A=fear' WHEN 2 THEN 'B=joy' ELSE '' END AS speakers, turn % 5 != 3 AS valid FROM q""")
def _(spark, sf):
    kind = F.col("scene_pos") % 5
    reply = (
        F.when(kind == 0, F.format_string('{"speaker_emotions": {"O\'Brien %d": ["joy"]}}', "book_id"))
        .when(kind == 1, '{"summary": "first", "summary": "last", "speaker_emotions": {"A": "joy", "A": "fear"}}')
        .when(kind == 2, '{"speaker_emotions": {"B": ["joy"]}, "character_emotions": null}')
        .when(kind == 3, '["a", "list"]').otherwise('{"summary": 5, "speaker_emotions": "x"}')
    )
    t = turns(spark, sf).select("book_id", "scene_pos").distinct().withColumn("reply", reply).withColumn("c", C.reply_context(F.col("reply")))
    listed = lambda m: F.coalesce(F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "+"))), ","), F.lit(""))
    return t.select("book_id", "scene_pos", F.coalesce("c.summary", F.lit("")).alias("summary"), listed("c.character_emotions").alias("people"), listed("c.speaker_emotions").alias("speakers"), F.col("c").isNotNull().alias("valid"))


@query("asked_contexts", "SELECT conv_id AS book_id, turn AS scene_pos, CASE WHEN length(t) % 5 = 0 THEN 'llm_error' ELSE 'llm' END AS source, CASE WHEN length(t) % 5 = 0 THEN 'Scene ' || conv_id || '.' || turn || ': TimeoutError: no answer' END AS error FROM (SELECT conv_id, turn, min(coalesce(text, '')) AS t FROM conversations GROUP BY ALL)")
def _(spark, sf):
    def provider():
        def ask(prompts):
            if any(len(p) % 5 == 0 for p in prompts):
                raise TimeoutError("no answer")
            return ["{}"] * len(prompts)

        return ask

    scenes = turns(spark, sf).groupBy("book_id", "scene_pos").agg(F.min(F.coalesce("text", F.lit(""))).alias("prompt"))
    replies = C.asked(scenes, provider, retries=0)
    return C.chosen(scenes, replies, ["book_id", "scene_pos"], use_heuristic=False).select("book_id", "scene_pos", "source", "error")


@query("plugged_scores", "SELECT doc_id, (length(coalesce(text, '')) % 10)::DOUBLE / 10 AS even, (length(coalesce(text, '')) % 7)::DOUBLE / 7 AS odd FROM documents")
def _(spark, sf):
    score = S.scorer(["even", "odd"], lambda: lambda texts: [[len(x) % 10 / 10, len(x) % 7 / 7] for x in texts])
    d = read(spark, sf, "documents").select("doc_id", score("text").alias("s"))
    return d.select("doc_id", F.col("s.even").alias("even"), F.col("s.odd").alias("odd"))


@query("approval_cues", "SELECT doc_id, doc_id % 3 = 0 AS approves FROM documents")
def _(spark, sf):
    said = F.when(F.col("doc_id") % 3 == 0, "She praised him.").when(F.col("doc_id") % 3 == 1, "He would never, in all his days, approve.").otherwise("Nothing of it.")
    return read(spark, sf, "documents").select("doc_id", C.has_approval(F.concat_ws(" ", F.regexp_replace("text", r"(?i)approve|praise|right thing|well done", "x"), F.lit("-" * 40), said)).alias("approves"))


# --- geometry and headings


@query("centered_lines", "SELECT doc_id, abs(((doc_id % 200) + (300 + doc_id % 300)) / 2.0 - 300) <= 84 AS centered FROM documents")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 200).cast("double").alias("x0"), (300 + F.col("doc_id") % 300).cast("double").alias("x1"), F.lit(600.0).alias("page_width"))
    return d.select("doc_id", L.is_centered().alias("centered"))


@query("subtitle_lines", "SELECT doc_id, doc_id % 4 IN (0, 1) AS subtitle FROM documents")
def _(spark, sf):
    # a large line, a narrow centred one, one as wide as the page, and body text below a heading
    d, kind = read(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), (F.col("doc_id") % 4).alias("kind")), F.col("kind")
    at = lambda name, value: value.cast("double").alias(name)
    subtitle = F.when(kind == 3, F.lit("and so it went on and on through all of that long and weary day, until the evening came.")).otherwise("A Quiet Day")
    wide = kind.isin(0, 2, 3)
    rows = [d.select("book_id", F.lit(k).alias("line_no"), text.alias("text"), at("x0", F.when(F.lit(k == 1) & ~wide, F.lit(200)).otherwise(F.lit(50))), at("x1", F.when(F.lit(k == 1) & ~wide, 400).otherwise(550)), at("font_size", F.when(F.lit(k == 1) & (kind == 0), 16).otherwise(12)), at("y0", F.lit(30 + 18 * k))) for k, text in enumerate([F.lit("Chapter 1"), subtitle, F.lit("Body text that goes on."), F.lit("More of the same text.")])]
    lines = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    lines = lines.withColumns({"page_num": F.lit(1), "y1": F.col("y0") + 12, "page_width": F.lit(600.0), "page_height": F.lit(800.0)})
    return H.marked_lines(lines).where("line_no = 1").select(F.col("book_id").alias("doc_id"), "subtitle")


BODY = "It was a long and quiet day by the river, and nobody came to the house until the evening, when the rain had ended."


#: Points: numeric with subtitle 4.7, title only 1.5, numeric 3.5; centred 1.3, short 1, first on the page 1, before body 1.3; display case 0.8.
@query("numbered_candidates", """WITH d AS (SELECT doc_id, doc_id % 3 AS kind, doc_id % 900 + 1 AS n, 100 + doc_id % 900 AS h FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN n || ' A Quiet Day' WHEN 1 THEN 'A Quiet Day In The Garden' ELSE n::VARCHAR END AS title, CASE kind WHEN 2 THEN 0 ELSE 1 END AS end_line,
round(CASE kind WHEN 0 THEN 10.1 WHEN 1 THEN 6.9 ELSE 8.1 END + CASE WHEN 30 <= 0.12 * h THEN 2.0 WHEN 30 <= 0.25 * h THEN 1.3 ELSE 0 END, 3)::DOUBLE AS score,
CASE kind WHEN 0 THEN 'numeric-heading,numeric-with-subtitle' WHEN 1 THEN 'title-only' ELSE 'numeric-heading' END || CASE WHEN 30 <= 0.12 * h THEN ',very-top' WHEN 30 <= 0.25 * h THEN ',top' ELSE '' END
|| ',centered,short' || CASE kind WHEN 2 THEN '' ELSE ',display-case' END || ',isolated-before,followed-by-body' AS reasons FROM d""")
def _(spark, sf):
    number, kind = (F.col("doc_id") % 900 + 1).cast("string"), F.col("doc_id") % 3
    texts = F.when(kind == 0, F.array(number, F.lit("A Quiet Day"), F.lit(BODY))).when(kind == 1, F.array(F.lit("A Quiet Day"), F.lit("In The Garden"), F.lit(BODY))).otherwise(F.array(number, F.lit(BODY)))
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("book_id"), (100.0 + F.col("doc_id") % 900).alias("page_height"), F.posexplode(texts).alias("line_no", "text"))
    y = 30.0 + 18.0 * F.col("line_no")
    lines = rows.withColumns({"page_num": F.lit(1), "x0": F.lit(50.0), "x1": F.lit(550.0), "y0": y, "y1": y + 12, "font_size": F.lit(12.0), "page_width": F.lit(600.0)})
    return H.resolved(H.candidates(lines)).select(F.col("book_id").alias("doc_id"), "title", F.col("end_global").cast("int").alias("end_line"), "score", F.array_join("reasons", ",").alias("reasons"))


@query("selected_headings", """WITH c AS (SELECT doc_id // 10 AS book, doc_id, CASE doc_id % 10 WHEN 0 THEN 's' WHEN 1 THEN 's' WHEN 2 THEN CASE WHEN doc_id // 10 % 2 = 0 THEN 's' ELSE 'n' END WHEN 3 THEN 'n' WHEN 4 THEN 't' WHEN 5 THEN 'by' WHEN 6 THEN 'weak' ELSE 'loose' END AS kind FROM documents),
m AS (SELECT *, kind IN ('s', 'n', 't') AS major FROM c), f AS (SELECT *, bool_or(major) OVER (PARTITION BY book) AS any_major, count(*) FILTER (WHERE kind = 's') OVER (PARTITION BY book) AS strong FROM m)
SELECT doc_id FROM f WHERE (major OR NOT any_major) AND (strong < 3 OR kind = 's')""")
def _(spark, sf):
    part, book = F.col("doc_id") % 10, F.floor(F.col("doc_id") / 10)
    structured, numeric = part.isin(0, 1) | ((part == 2) & (book % 2 == 0)), (part == 3) | ((part == 2) & (book % 2 == 1))
    title = F.when(structured, F.concat(F.lit("Chapter "), "doc_id")).when(numeric, F.col("doc_id").cast("string")).when(part == 5, "by the sea").otherwise("A Quiet Day")
    c = read(spark, sf, "documents").select(
        book.alias("book_id"), F.lit(1).alias("page_num"), F.lower(title).alias("norm"), F.col("doc_id").alias("start_global"), F.col("doc_id").alias("end_global"), title.alias("title"), F.lit("chapter").alias("kind"),
        F.when(part == 6, 6.9).otherwise(7.0).alias("score"), structured.alias("structured"), numeric.alias("numeric"), (part < 7).alias("followed"),
    )
    return H.selected(c).select(F.col("start_global").alias("doc_id"))


@query("adjacent_titles", "WITH c AS (SELECT doc_id, source, (doc_id // 7) % 3 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents), r AS (SELECT *, page - row_number() OVER (PARTITION BY source, t ORDER BY page) AS run FROM c), b AS (SELECT *, row_number() OVER w AS k, coalesce((doc_id * 7919 % 5) > lag(doc_id * 7919 % 5) OVER w, true) AS better, coalesce(lead(doc_id * 7919 % 5) OVER w > (doc_id * 7919 % 5), false) AS ahead FROM r WINDOW w AS (PARTITION BY source, t, run ORDER BY page)), s AS (SELECT *, k - max(CASE WHEN better THEN k END) OVER (PARTITION BY source, t, run ORDER BY page) AS since FROM b) SELECT doc_id FROM s WHERE since % 2 = 0 AND NOT ahead")
def _(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source")
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    c = d.select(F.col("source").alias("book_id"), page.alias("page_num"), F.concat(F.lit("t"), F.floor(F.col("doc_id") / 7) % 3).alias("norm"), F.col("doc_id").alias("start_global"), F.col("doc_id").alias("end_global"), F.lit("T").alias("title"), (F.col("doc_id") * 7919 % 5).cast("double").alias("score"))
    return H.resolved(c).select(F.col("start_global").alias("doc_id"))


@query("outputs_cleaned", "SELECT unnest(['other', 'scenes_of_mine']) AS name, count(*) AS n FROM documents")
def _(spark, sf):
    root = shared_path(spark, "outputs")
    d = read(spark, sf, "documents").select("doc_id")
    for name in ("scenes", "results", "other", "scenes_of_mine"):
        d.write.parquet(f"{root}/{name}")
    gone = sinks.clean_outputs(spark, root)
    assert sorted(x.rsplit("/", 1)[1] for x in gone) == ["results", "scenes"]
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    left = [x.getPath().getName() for x in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    rows = [spark.read.parquet(f"{root}/{x}").agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in left]
    return rows[0].unionByName(rows[1])

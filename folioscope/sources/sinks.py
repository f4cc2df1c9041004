"""Sinks: JSON documents, wide CSV, texts, stage tables, reports and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cut import cut
from ..operators.headings import Detection
from ..operators.layout import matched, removed_preview
from ..operators.profiles import book_scores, top_k

#: Names of the tables that one run writes.
STAGES = ("scenes", "raw_scores", "contexts", "normalized", "chapter_profiles", "book_profiles", "character_profiles", "calibration", "chapter_texts", "block_texts", "results")


def _score_map(by: str = "average_score"):
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.round(by, 6).alias("score")))))


def _tops(scores: DataFrame, keys: list[str], k: int, by: str) -> DataFrame:
    top = top_k(scores, keys, k, by)
    item = F.struct("rank", "label", F.round(by, 6).alias("score"))
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["label"], x["score"])).alias("top_emotions"))


def result_documents(profile: DataFrame, chapters: DataFrame | None = None, blocks: DataFrame | None = None, k: int = 5) -> DataFrame:
    """One JSON document per book: its chapters in order with titles and pages (of ``chapters``),
    top emotions and scores by label, its blocks in order, and the book's scores and top ten.

    A document is put together on an executor; it has one book's chapters and blocks."""
    keys = ["book_id", "chapter_index"]
    rows = matched(profile.groupBy(*keys).agg(_score_map().alias("scores"), F.max("scene_count").alias("scene_count")), _tops(profile, keys, k, "average_score"), keys)
    if chapters is None:
        rows = rows.withColumns({"title": F.lit(None).cast("string"), "start_page": F.lit(None).cast("int"), "end_page": F.lit(None).cast("int")})
    else:
        rows = matched(rows, chapters.select(*keys, F.col("chapter_title").alias("title"), "start_page", "end_page"), keys, "left")
    by = lambda name: lambda x, y: (x[name] - y[name]).cast("int")
    item = F.struct("chapter_index", "title", "start_page", "end_page", "scene_count", "top_emotions", "scores")
    doc = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(item), by("chapter_index")).alias("chapters"), F.count("*").alias("num_chapters"))
    whole = book_scores(profile)
    book = matched(whole.groupBy("book_id").agg(_score_map("score").alias("book_level_scores")), _tops(whole, ["book_id"], 10, "score").withColumnRenamed("top_emotions", "book_level_top_emotions"), ["book_id"])
    doc = matched(doc, book, ["book_id"])
    fields = ["num_chapters", "book_level_top_emotions", "book_level_scores", "chapters"]
    if blocks is not None:
        item = F.struct("block_index", "chapter_index", "scene_index", "scene_ref", "top", "above")
        doc = matched(doc, blocks.groupBy("book_id").agg(F.array_sort(F.collect_list(item), by("block_index")).alias("blocks")), ["book_id"], "left")
        fields.append("blocks")
    return doc.select("book_id", F.to_json(F.struct(*fields)).alias("result_json"))


def wide(scores: DataFrame, keys: list[str], labels: list[str], by: str = "score") -> DataFrame:
    """Keys, the top label and score, and a column per label; labels are given, so the pivot
    runs no job of its own."""
    best = scores.groupBy(*keys).agg(F.max(by).alias("top_1_score"), F.min_by("label", F.struct(-F.col(by), F.col("label"))).alias("top_1"))
    pivot = scores.groupBy(*keys).pivot("label", sorted(labels)).agg(F.first(by))
    return matched(best.select(*keys, F.coalesce("top_1", F.lit("")).alias("top_1"), "top_1_score"), pivot, keys)


def wide_blocks(scores: DataFrame, blocks: DataFrame, labels: list[str]) -> DataFrame:
    """``wide`` by block: block_index first, then chapter, scene and the labels."""
    keys = ["book_id", "chapter_index", "scene_index"]
    return matched(wide(scores, keys, labels), blocks.select(*keys, "block_index"), keys).select("book_id", "block_index", "chapter_index", "scene_index", "top_1", "top_1_score", *sorted(labels))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def safe_name(*parts):
    return F.regexp_replace(F.concat_ws("_", *parts), "[^A-Za-z0-9._-]+", "_")


def padded(c: str, width: int = 3):
    """A number with leading zeros; a longer one as it is (``lpad`` would cut it)."""
    text = F.col(c).cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def text_names(rows: DataFrame) -> DataFrame:
    """Chapters, or scenes, with the ``name`` of their text object: ``chapter_NNN_title``, or
    ``block_NNN_chapter_NNN_scene_NNN`` by the scene's place in its book (``scene_pos``)."""
    if "scene_index" in rows.columns:
        parts = [F.lit("block"), padded("scene_pos"), F.lit("chapter"), padded("chapter_index"), F.lit("scene"), padded("scene_index")]
    else:
        parts = [F.lit("chapter"), padded("chapter_index"), F.coalesce("chapter_title", F.lit("")) if "chapter_title" in rows.columns else F.lit("")]
    return rows.withColumn("name", safe_name(*parts))


def write_texts(rows: DataFrame, path: str) -> None:
    """One text object per chapter or scene, under its book and name."""
    text_names(rows).select("book_id", "name", "text").write.mode("overwrite").partitionBy("book_id", "name").text(path)


def write_stage(df: DataFrame, path: str, name: str) -> None:
    """A stage table; only the books present are overwritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(f"{path}/{name}")


def clean_outputs(spark: SparkSession, path: str, names: tuple[str, ...] = STAGES) -> list[str]:
    """Removes the tables of an earlier run, by name, through the file system of the path; all
    else stays. The list of what was removed."""
    gone = []
    for name in names:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(where) and fs.delete(where, True):
            gone.append(f"{path}/{name}")
    return gone


def detection_report(d: Detection, lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(book_id, total_pages, total_lines, candidates by kind, chapters, report): counts as
    columns and the whole report as JSON. ``lines`` are those before edges were removed."""
    key = ["book_id"]
    counted = lines.groupBy("book_id").agg(F.max("page_num").cast("long").alias("total_pages")) if pages is None else pages.groupBy("book_id").agg(F.count("*").alias("total_pages"))
    kinds = {f"{k}_candidates": F.count_if(F.col("kind") == k) for k in ("chapter", "front", "back")}
    item = F.struct("start_global", "end_global", "title", "kind", "score", "page_num", "reasons")
    cand = d.candidates.groupBy("book_id").agg(*[v.alias(k) for k, v in kinds.items()], F.array_sort(F.collect_list(item)).alias("all_candidates"))
    picked = d.selected.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("start_global", "title", "score", "page_num", "reasons"))).alias("selected_chapter_candidates"))
    chap = d.chapters.groupBy("book_id").agg(
        F.count("*").alias("chapters"), F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_list(F.struct("chapter_index", "chapter_title", "start_page", "end_page", F.length("text").alias("char_count")))).alias("chapter_list")
    )
    body = d.body.groupBy("book_id").agg(F.min("page_num").alias("body_start_page"), F.max("page_num").alias("body_end_page"), F.count("*").alias("body_lines"))
    preview = removed_preview(lines, 10, pages).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("rank", "preview"))).alias("p")).select("book_id", F.transform("p", lambda x: x["preview"]).alias("removed"))
    out = d.window
    for part in (counted, cand, picked, chap, body, preview):  # each written, so that its shuffle files go before the next
        out = matched(out, cut(part), key, "left")
    numbers = ["chapter_candidates", "front_candidates", "back_candidates", "chapters", "chars", "body_lines"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    return out.select("book_id", "total_pages", *numbers, "start_reason", "end_reason", F.to_json(F.struct(*[c for c in out.columns if c != "book_id"])).alias("report"))


def summary(profile: DataFrame, k: int = 3) -> DataFrame:
    """One line per chapter with its top labels."""
    return _lines(profile, ["book_id", "chapter_index"], k, "average_score")


def book_summary(profile: DataFrame, k: int = 10) -> DataFrame:
    """One line per book with its top labels."""
    return _lines(book_scores(profile), ["book_id"], k, "score")


def _lines(scores: DataFrame, keys: list[str], k: int, by: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc(), "label")
    top = scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.format_string("%s=%.4f", "label", by).alias("x")))), lambda x: x["x"]), ", ")
    return top.groupBy(*keys).agg(parts.alias("line"))

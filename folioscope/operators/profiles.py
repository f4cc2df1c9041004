"""Roll-ups of long score tables (book_id, chapter_index, scene_index, label, score).

A label that a scene lacks counts as 0 and the scene still counts in the denominator. Ties
go to the smaller label, scene or chapter. Ranks are window functions over small partitions
(the labels of a chapter or book); sums are partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cut import cut
from .layout import matched

NEUTRAL = "neutral"
#: Fields that a slim result leaves out.
LARGE_FIELDS = ("scene_results", "raw_book_level_scores")


def chapter_profile(scores: DataFrame, include_neutral: bool = True) -> DataFrame:
    """Scene-weighted mean, maximum and scene count per chapter and label; ``weight`` >= 1.

    A scene that lacks a label counts for it as 0, so the chapter's weight is that of all its
    scenes. A ``raw_score`` column, where there is one, gives ``raw_average_score`` likewise."""
    if not include_neutral:
        scores = scores.where(F.lower("label") != NEUTRAL)
    w = F.greatest(F.col("weight"), F.lit(1.0))
    keys = ["book_id", "chapter_index"]
    raw = "raw_score" in scores.columns
    sums = scores.groupBy(*keys, "label").agg(F.sum(F.col("score") * w).alias("s"), F.max("score").alias("max_score"), *([F.sum(F.col("raw_score") * w).alias("r")] if raw else []))
    scenes = scores.groupBy(*keys, "scene_index").agg(F.max(w).alias("w")).groupBy(*keys).agg(F.sum("w").alias("w"), F.count("*").alias("scene_count"))
    cols = [*keys, "label", (F.col("s") / F.col("w")).alias("average_score"), "max_score", "scene_count", *([(F.col("r") / F.col("w")).alias("raw_average_score")] if raw else [])]
    return matched(sums, scenes, keys).select(*cols)


def top_k(scores: DataFrame, keys: list[str], k: int, by: str = "score", include_neutral: bool = True) -> DataFrame:
    if not include_neutral:
        scores = scores.where(F.col("label") != NEUTRAL)
    order = Window.partitionBy(*keys).orderBy(F.col(by).desc(), "label")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def above_threshold(scores: DataFrame, threshold: float = 0.3, by: str = "score") -> DataFrame:
    return scores.where(F.col(by) >= threshold)


def intensity(scores: DataFrame) -> DataFrame:
    """The largest non-neutral score of every scene; 0 if there is none."""
    value = F.max(F.when(F.col("label") != NEUTRAL, F.col("score")))
    return scores.groupBy("book_id", "chapter_index", "scene_index").agg(F.coalesce(value, F.lit(0.0)).alias("intensity"))


def intense_scenes(scores: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("book_id", "chapter_index").orderBy(F.col("intensity").desc(), "scene_index")
    return intensity(scores).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_scenes_by_emotion(scores: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("book_id", "chapter_index", "label").orderBy(F.col("score").desc(), "scene_index")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mean_scores(rows: DataFrame, keys: list[str], row_keys: list[str], by: str = "score") -> DataFrame:
    """Mean per label over all rows of a group, absent labels as 0."""
    total = rows.select(*keys, *row_keys).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    return matched(rows.groupBy(*keys, "label").agg(F.sum(by).alias("s")), total, keys).select(*keys, "label", (F.col("s") / F.col("n")).alias("score"))


def book_scores(profile: DataFrame) -> DataFrame:
    rounded = profile.withColumn("average_score", F.round("average_score", 6))
    return mean_scores(rounded, ["book_id"], ["chapter_index"], "average_score")


def chapter_arc(profile: DataFrame, k: int = 5) -> DataFrame:
    """Top labels of every chapter joined to a string, and its intensity."""
    top = top_k(profile, ["book_id", "chapter_index"], k, "average_score")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), ",")
    peak = profile.groupBy("book_id", "chapter_index").agg(F.max(F.when(F.col("label") != NEUTRAL, F.col("average_score"))).alias("intensity"))
    return matched(top.groupBy("book_id", "chapter_index").agg(listed.alias("top")), peak, ["book_id", "chapter_index"])


def trends(profile: DataFrame, by: str = "average_score") -> DataFrame:
    """First, last, delta and the first chapter of the highest score, per book and label."""
    c = F.col("chapter_index")
    return (
        profile.groupBy("book_id", "label")
        .agg(
            F.min_by(by, c).alias("first_score"),
            F.max_by(by, c).alias("last_score"),
            F.max(F.struct(F.col(by).alias("s"), (-c).alias("c"))).alias("peak"),
        )
        .select("book_id", "label", "first_score", "last_score", (F.col("last_score") - F.col("first_score")).alias("delta"), (-F.col("peak.c")).alias("peak_chapter"), F.col("peak.s").alias("peak_score"))
    )


def ranked_trends(trend: DataFrame, kind: str) -> DataFrame:
    """kind: rising (8), falling (8) or peaks (12)."""
    by, k = {"rising": (F.col("delta").desc(), 8), "falling": (F.col("delta").asc(), 8), "peaks": (F.col("peak_score").desc(), 12)}[kind]
    order = Window.partitionBy("book_id").orderBy(by, "label")
    return trend.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def plot_labels(rows: DataFrame, row_keys: list[str], k: int = 8, include_neutral: bool = False, by: str = "score") -> DataFrame:
    return top_k(mean_scores(rows, ["book_id"], row_keys, by), ["book_id"], k, include_neutral=include_neutral)


def trajectory(profile: DataFrame, k: int = 8, axis: str = "chapter_index", by: str = "average_score") -> DataFrame:
    """A score for every chapter (or block, by ``axis``) and plotted label, 0 where absent.

    A book's axis is collected to rows once: one map of scores for every point, from which the
    plotted labels are taken. The profile is computed once, to a written table.
    """
    profile = cut(profile.select("book_id", axis, "label", by))
    labels = plot_labels(profile, [axis], k, by=by).groupBy("book_id").agg(F.collect_list("label").alias("labels"))
    points = profile.groupBy("book_id", axis).agg(F.map_from_entries(F.collect_list(F.struct("label", by))).alias("scores"))
    rows = matched(points, labels, ["book_id"]).select("book_id", axis, "scores", F.explode("labels").alias("label"))
    return rows.select("book_id", axis, "label", F.coalesce(F.try_element_at("scores", F.col("label")), F.lit(0.0)).alias("score"))


def timeline_labels(profile: DataFrame, k: int = 3) -> DataFrame:
    """Union of the chapters' top labels, in the order in which they are first seen."""
    top = top_k(profile, ["book_id", "chapter_index"], k, "average_score")
    first = top.groupBy("book_id", "label").agg(F.min(F.struct("chapter_index", "rank")).alias("p"))
    return first.select("book_id", "label", F.row_number().over(Window.partitionBy("book_id").orderBy("p")).alias("position"))


def blocks(scores: DataFrame, threshold: float = 0.3, k: int = 5, include_neutral: bool = True) -> DataFrame:
    """A row per scene with its place in the book, top labels and labels above the threshold.

    A scene's labels are ordered within the row; scenes are numbered within their chapter and
    chapters get the number of scenes before them, so a book is in one task with its chapters'
    counts only."""
    keys = ["book_id", "chapter_index", "scene_index"]
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "label")))
    if not include_neutral:
        scores = scores.where(F.lower("label") != NEUTRAL)
    rows = scores.groupBy(*keys).agg(items.alias("items"))
    named = lambda a: F.array_join(F.transform(a, lambda x: x["label"]), ",")
    rows = rows.select(*keys, named(F.slice("items", 1, k)).alias("top"), named(F.filter("items", lambda x: -x["neg"] >= threshold)).alias("above"))
    chapter = Window.partitionBy("book_id", "chapter_index").orderBy("scene_index")
    before = Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = matched(rows.withColumn("place", F.row_number().over(chapter)), counts, ["book_id", "chapter_index"])
    ref = F.concat_ws(".", F.col("chapter_index").cast("string"), F.col("scene_index").cast("string"))
    return placed.withColumn("block_index", F.col("ahead") + F.col("place")).withColumn("scene_ref", ref).drop("ahead", "place")


def perspective_profiles(rows: DataFrame, k: int = 8, include_neutral: bool = True) -> DataFrame:
    """rows(book_id, chapter_index, scene_index, p struct(narrator, character) of score maps) ->
    (book_id, perspective, rank, label, score): the top labels of the mean over all scenes."""
    keys = ["chapter_index", "scene_index"]
    both = F.explode(F.array(*[F.struct(F.lit(x).alias("perspective"), F.col(f"p.{x}").alias("scores")) for x in ("narrator", "character")])).alias("x")
    long = rows.select("book_id", *keys, both).select("book_id", *keys, "x.perspective", F.explode("x.scores").alias("label", "score"))
    return top_k(mean_scores(long, ["book_id", "perspective"], keys), ["book_id", "perspective"], k, include_neutral=include_neutral).select("book_id", "perspective", "rank", "label", "score")


def average_confidence(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book_id").agg(F.round(F.avg("confidence"), 6).alias("average_scene_confidence"))


def character_votes(scenes: DataFrame, include_neutral: bool = True) -> DataFrame:
    """Scenes with a context (characters, character_emotions, speaker_emotions, character_scores)
    -> (book_id, name, scene_pos, mention, label, votes, seen).

    Names are the characters, or else those of the two maps; each mention gets two votes for
    every emotion that the maps give its cleaned name, and for the three strongest of the
    scene's character scores the score in tenths, half to even, 1 at least. A mention without a
    vote is a row without a label. ``seen`` orders votes within the book.
    """
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.col("characters"), none)
    keys = lambda c: F.coalesce(F.map_keys(c), none)
    named = F.when(F.size(listed) > 0, listed).when(F.size(keys("character_emotions")) > 0, keys("character_emotions")).otherwise(keys("speaker_emotions"))
    strong = F.map_entries("character_scores") if include_neutral else F.filter(F.map_entries("character_scores"), lambda x: F.lower(x["key"]) != NEUTRAL)
    strong = F.slice(F.array_sort(F.transform(strong, lambda x: F.named_struct(F.lit("neg"), -x["value"], F.lit("label"), x["key"]))), 1, 3)
    rows = scenes.select("book_id", "scene_pos", "character_emotions", "speaker_emotions", strong.alias("strong"), F.posexplode(named).alias("mention", "raw"))
    rows = rows.withColumn("name", T.clean_line("raw")).where("name != ''")
    explicit = F.concat(*[F.coalesce(F.try_element_at(c, F.col("name")), none) for c in ("character_emotions", "speaker_emotions")])
    two = F.transform(explicit, lambda e: F.named_struct(F.lit("label"), F.lower(e), F.lit("votes"), F.lit(2).cast("long")))
    more = F.transform("strong", lambda x: F.named_struct(F.lit("label"), x["label"], F.lit("votes"), F.greatest(F.lit(1), F.bround(-x["neg"] * 10, 0)).cast("long")))
    votes = rows.select("book_id", "name", "scene_pos", "mention", F.posexplode_outer(F.concat(two, more)).alias("nth", "vote"))
    return votes.select("book_id", "name", "scene_pos", "mention", F.col("vote.label").alias("label"), F.coalesce("vote.votes", F.lit(0)).alias("votes"), F.struct("scene_pos", "mention", "nth").alias("seen"))


def character_profiles(votes: DataFrame, k: int = 8, include_neutral: bool = False) -> DataFrame:
    """votes(book_id, name, scene_pos, label, votes) -> mentions and the top vote shares.

    Shares divide by all votes; the top is cut before neutral goes. Mentions are counted by
    ``mention`` within a scene where the votes have it, else by scene; ties go to the first vote
    where they have ``seen``, else to the smaller label.
    """
    mention = F.struct("scene_pos", "mention") if "mention" in votes.columns else F.col("scene_pos")
    total = votes.groupBy("book_id", "name").agg(F.sum("votes").alias("all_votes"), F.count_distinct(mention).alias("mentions"))
    first = F.min("seen") if "seen" in votes.columns else F.lit(None)
    each = matched(votes.where("label IS NOT NULL").groupBy("book_id", "name", "label").agg(F.sum("votes").alias("v"), first.alias("seen")), total, ["book_id", "name"])
    order = Window.partitionBy("book_id", "name").orderBy(F.col("v").desc(), "seen", "label")
    share = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    share = share.select("book_id", "name", "label", "mentions", (F.col("v") / F.col("all_votes")).alias("score"), "rank")
    return share if include_neutral else share.where(F.lower("label") != NEUTRAL)


def sample_scenes(votes: DataFrame, k: int = 8) -> DataFrame:
    """(book_id, name, nth, scene_pos): the first ``k`` mentions of every character."""
    order = Window.partitionBy("book_id", "name").orderBy("scene_pos", "mention")
    return votes.select("book_id", "name", "scene_pos", "mention").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("book_id", "name", "nth", "scene_pos")


def drop_short_chapters(chapters: DataFrame, least: int = 100) -> DataFrame:
    """Chapters of ``least`` characters or more, renumbered where a book lost any;
    ``source_chapter_index`` is kept. Only indexes go through the book's window."""
    keys = ["book_id", "chapter_index"]
    book = Window.partitionBy("book_id").orderBy("chapter_index")
    long = chapters.select(*keys, (F.length("text") >= least).alias("long"))
    lost = F.max((~F.coalesce("long", F.lit(False))).cast("int")).over(Window.partitionBy("book_id"))
    index = long.withColumn("lost", lost).where("long").withColumn("new", F.when(F.col("lost") == 1, F.row_number().over(book)).otherwise(F.col("chapter_index")))
    kept = matched(chapters, index.select(*keys, "new"), keys)
    return kept.withColumnRenamed("chapter_index", "source_chapter_index").withColumnRenamed("new", "chapter_index")


def slim(results: DataFrame, use_paragraphs: Column | bool, fields: tuple[str, ...] = LARGE_FIELDS) -> DataFrame:
    """Result rows without the large fields, and without blocks unless they are asked for.

    results has ``blocks`` (an array), ``chapters`` (an array of structs, whose
    most_intense_scenes go) and any of ``fields``."""
    asked = F.lit(use_paragraphs) if isinstance(use_paragraphs, bool) else use_paragraphs
    out = results.drop(*fields).withColumn("use_paragraph_analysis", asked)
    if "chapters" in out.columns:
        out = out.withColumn("chapters", F.transform("chapters", lambda c: c.dropFields("most_intense_scenes")))
    if "blocks" in out.columns:
        out = out.withColumn("blocks", F.when(F.col("use_paragraph_analysis"), F.col("blocks")))
        out = out.withColumn("num_blocks", F.coalesce(F.size("blocks"), F.lit(0)).cast("long")).withColumn("num_blocks", F.greatest("num_blocks", F.lit(0)))
    return out


def percent(score: Column) -> Column:
    return F.format_string("%.1f", score * 100)


def page_range(start: Column, end: Column) -> Column:
    """"3-7", or null where there are no real pages (none, or 1 to 1 as a text file has)."""
    real = start.isNotNull() & end.isNotNull() & (start != 0) & (end != 0) & ~((start == 1) & (end == 1))
    return F.when(real, F.concat_ws("-", start.cast("string"), end.cast("string")))

"""Scene scores: model plug-ins, chunk blending, correction, confidence and calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cut import cut
from .layout import matched
from .profiles import NEUTRAL
from .quantile import exact_medians
from .segment import chunks

#: Tones that speak against joy and approval, and meanings that aren't approval.
NEGATIVE_TONES = ("sadness", "grief", "remorse", "fear", "anxiety", "despair", "tragic", "tense")
MORAL = "compassion|forgiveness|moral acceptance|respect"


def scorer(labels: list[str], load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 8):
    """A vectorised scorer text -> map of label to score; ``load`` runs once per worker."""

    @F.pandas_udf("map<string,double>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for series in texts:
            rows = series.fillna("").tolist()
            out = [r for k in range(0, len(rows), batch) for r in model(rows[k : k + batch])]
            yield pd.Series([dict(zip(labels, r, strict=True)) for r in out])

    return score


def lexicon_scores(text: Column, lexicon: dict[str, str], half: float = 2.0) -> Column:
    """Stand-in scorer: hits / (hits + half) for every pattern, by built-in functions."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda p: F.regexp_count(t, F.lit(p)).cast("double")
    return F.create_map(*[x for k, p in sorted(lexicon.items()) for x in (F.lit(k), hit(p) / (hit(p) + F.lit(half)))])


def sigmoid_scores(logits: Column, labels: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.transform(logits, lambda x: 1 / (1 + F.exp(-x))))


def long_scores(rows: DataFrame, keys: list[str], scores: str = "scores") -> DataFrame:
    return rows.select(*keys, F.explode(scores).alias("label", "score"))


def combine_chunks(chunks: DataFrame, keys: list[str], peak_blend: float = 0.3) -> DataFrame:
    """(keys, words, label, score) of chunks -> word-weighted mean blended with the peak."""
    b = min(max(peak_blend, 0.0), 0.75)
    w = F.greatest(F.col("words"), F.lit(1)).cast("double")
    g = chunks.groupBy(*keys, "label").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("mean"), F.max("score").alias("peak"))
    blend = F.when(F.col("label") == NEUTRAL, F.col("mean")).otherwise(F.col("mean") * (1 - b) + F.col("peak") * b)
    return g.select(*keys, "label", F.least(F.greatest(blend, F.lit(0.0)), F.lit(1.0)).alias("score"))


def scene_scores(
    scenes: DataFrame, score: Callable[[Column], Column], most: int = 512, overlap: int = 64, tokens: Callable[[str], list[str]] | None = None, peak_blend: float = 0.3, parts: int | None = None
) -> DataFrame:
    """Scenes -> (book_id, chapter_index, scene_index, scores, chunk_count): chunks, scored one by
    one and combined. ``score`` maps a text column to a map of scores, a plug-in (``scorer``) or
    built-in functions. Scenes without a chunk are dropped. ``parts`` deals chunks over so many
    tasks before a costly scorer; a book with many chunks is no task of its own then."""
    keys = ["book_id", "chapter_index", "scene_index"]
    c = chunks(scenes, most, overlap, tokens)
    if parts:
        c = c.repartition(parts)
    scored = cut(c.withColumns({"words": T.count_words("text"), "scores": score(F.col("text"))}).drop("text"))  # a scorer runs once
    long = combine_chunks(scored.select(*keys, "words", F.explode("scores").alias("label", "score")), keys, peak_blend)
    whole = long.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "score")))).alias("scores"))
    return matched(whole, scored.groupBy(*keys).agg(F.count("*").alias("chunk_count")), keys)


def intensity(scores: Column, include_neutral: bool = False) -> Column:
    kept = scores if include_neutral else F.map_filter(scores, lambda k, _: k != NEUTRAL)
    return F.coalesce(F.array_max(F.map_values(kept)), F.lit(0.0))


def scene_weight(words: Column, scores: Column, confidence: Column) -> Column:
    return F.greatest(words, F.lit(1)) * (0.75 + F.least(F.lit(0.75), 2 * intensity(scores))) * (0.5 + confidence)


def _top_gap(scores: Column) -> Column:
    top = F.sort_array(F.map_values(F.map_filter(scores, lambda k, _: F.lower(k) != NEUTRAL)), asc=False)
    return F.when(F.size(top) >= 2, F.element_at(top, 1) - F.element_at(top, 2))


def confidence(words: Column, scores: Column, context_confidence: Column | None = None) -> Column:
    """.62, less for short, long or undecided scenes, more for clear or explained ones."""
    gap = _top_gap(scores)
    c = F.lit(0.62) + F.when(words < 80, -0.18).when(words > 1200, -0.08).otherwise(0.0)
    c = c + F.when(gap < 0.025, -0.12).when(gap > 0.12, 0.08).otherwise(0.0)
    if context_confidence is not None:
        c = c + F.coalesce(F.least(F.lit(0.18), 0.18 * context_confidence), F.lit(0.0))
    return F.least(F.greatest(c, F.lit(0.05)), F.lit(1.0))


def confidence_reasons(words: Column, scores: Column, source: Column | None = None) -> Column:
    """Why: length, then the gap between the two strongest, then the kind of context."""
    gap = _top_gap(scores)
    context = F.when(source == "heuristic", "heuristic context").when(source == "llm", "llm context") if source is not None else F.lit(None).cast("string")
    return F.array_compact(F.array(
        F.when(words < 80, "short scene").when(words > 1200, "long scene"), F.when(gap < 0.025, "close competing emotions").when(gap > 0.12, "clear dominant emotion"), context,
    ))


#: What a correction says of itself.
NOTE_OFF = "context normalization disabled"
NOTE_APPROVAL = "approval lowered: context or co-emotions suggest compassion/moral acceptance, not direct approval"
NOTE_JOY = "joy softened: scene appears tense or tragic"


def _correction(scores: Column, meaning: Column, tones: Column, direct: Column, enabled: Column) -> tuple[Column, Column, Column, Column]:
    """(old approval, is it damped, the raised sadness, is joy lowered)."""
    at = lambda k: F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0))
    a = at("approval")
    tragic = F.coalesce(F.arrays_overlap(F.transform(tones, F.lower), F.array(*[F.lit(t) for t in NEGATIVE_TONES])), F.lit(False))
    evidence = F.coalesce(F.lower(meaning).rlike(MORAL), F.lit(False)) | tragic | (at("sadness") >= 0.65 * a) | (at("fear") >= 0.55 * a) | (at("remorse") >= 0.45 * a)
    direct = F.coalesce(direct, F.lit(False))
    on = enabled & (a > 0) & ~direct
    damp = on & evidence
    has = F.map_contains_key(scores, "sadness")
    sad = F.when(damp & has, F.least(F.lit(1.0), at("sadness") + 0.12 * a)).otherwise(at("sadness"))
    return a, damp, sad, on & (at("joy") > 0) & (tragic | (sad > at("joy")))


def correct(scores: Column, meaning: Column, tones: Column, direct: Column, enabled: Column) -> Column:
    """Approval that is really compassion is damped, and joy in tense or tragic scenes."""
    a, damp, _, less_joy = _correction(scores, meaning, tones, direct, enabled)
    bump = lambda v, share: F.when(damp, F.least(F.lit(1.0), v + share * a)).otherwise(v)
    return F.transform_values(
        scores,
        lambda k, v: F.when((k == "approval") & damp, v * 0.55)
        .when(k == "caring", bump(v, 0.22))
        .when(k == "sadness", bump(v, 0.12))
        .when(k == "love", bump(v, 0.06))
        .when((k == "joy") & less_joy, v * 0.75)
        .otherwise(v),
    )


def correction_notes(scores: Column, meaning: Column, tones: Column, direct: Column, enabled: Column) -> Column:
    """What ``correct`` has done, in words."""
    _, damp, _, less_joy = _correction(scores, meaning, tones, direct, enabled)
    return F.array_compact(F.array(
        F.when(~enabled, NOTE_OFF),
        F.when(damp, NOTE_APPROVAL),
        F.when(less_joy, NOTE_JOY),
    ))


def medians(scores: DataFrame) -> DataFrame:
    """Exact median per book and label, by narrowing histograms: no book is gathered."""
    return exact_medians(scores, ["book_id", "label"], "score")


def calibrate(scores: DataFrame, include_neutral: bool = False, base: DataFrame | None = None) -> DataFrame:
    """Scores above a floor of 0.35 medians of their book, stretched back to [0, 1]; ``base`` are
    the medians, if they are known."""
    floor = 0.35 * F.col("median")
    stretched = F.greatest(F.lit(0.0), F.col("score") - floor) / F.greatest(F.lit(0.05), 1 - floor)
    moved = F.when((floor >= 0.95) | floor.isNull() | F.col("score").isNull(), F.col("score")).otherwise(F.round(F.least(F.greatest(stretched, F.lit(0.0)), F.lit(1.0)), 6))
    neutral = F.col("score") if include_neutral else F.round(F.col("score") * 0.7, 6)
    out = F.when(F.col("label") == NEUTRAL, neutral).otherwise(moved)
    base = medians(scores) if base is None else base
    return matched(scores, base, ["book_id", "label"], "left").withColumn("score", out).drop("median")


def calibration_report(scores: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Per book: the medians as text, and the number of scenes."""
    base = medians(scores) if base is None else base
    base = base.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("%s=%.4f", "label", "median"))), ",").alias("baseline"))
    n = scores.select("book_id", "chapter_index", "scene_index").distinct().groupBy("book_id").agg(F.count("*").alias("scenes"))
    return matched(base, n, ["book_id"])


def perspective(scores: Column, narrator_marks: Column, character_marks: Column, dominant: Column) -> Column:
    """struct(narrator, character): the scores by each perspective's share."""
    factor = lambda marks, kinds: lambda k, v: F.round(v * F.when(F.array_contains(marks, F.lower(k)) | dominant.isin(*kinds), 0.75).otherwise(0.35), 6)
    return F.struct(
        F.transform_values(scores, factor(narrator_marks, ("narrator",))).alias("narrator"),
        F.transform_values(scores, factor(character_marks, ("dialogue", "character"))).alias("character"),
    )


def with_neighbours(scenes: DataFrame, columns: list[str]) -> DataFrame:
    """previous_* and next_* of small columns, in book order."""
    w = Window.partitionBy("book_id").orderBy("scene_pos")
    for c in columns:
        scenes = scenes.withColumn(f"previous_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    return scenes

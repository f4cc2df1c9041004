"""Chapters to paragraphs, scenes and chunks. The folds are ``aggregate`` over a row's own
arrays: a chapter or a scene is one row, so no shuffle is needed, and only what a fold closes (a
scene, a chunk) is added to an array, so they are linear in the text. Python is for tokenizers
and translators that a user plugs in, and for the table function."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cut import cut
from .layout import matched

#: What opens a new scene.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SCENE_BREAK = (
    r"(?i)^(?:\*[\s*]{1,}\*|[-_]{3,}|chapter\s+\d+|part\s+\w+)$|^(?:letter|telegram|diary|journal|memorandum)\b"
    r"|^(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
    rf"|^(?:\d{{1,2}}\s+(?:{MONTHS})\b)|^(?:(?:{MONTHS})\s+\d{{1,2}}\b)"
)
TIME_SHIFT = r"(?i)\b(later|meanwhile|that evening|the next morning|the following day|at midnight|at dawn|afterwards|afterward)\b"
WORD = re.compile(r"\w[\w'-]*")


def split_paragraphs(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: T.strip(x)), lambda x: x != "")


def is_scene_break(text: Column | str) -> Column:
    t = T.clean_line(text)
    return T.matches(t, SCENE_BREAK) | ((T.count_words(t) <= 18) & T.matches(t, TIME_SHIFT) & (t != ""))


def pack_scenes(paragraphs: list[str], breaks: list[bool], least: int, target: int) -> list[tuple[int, int]]:
    """[first, last) paragraph of every scene; a short last scene joins the one before."""
    found = _pieces(paragraphs, breaks, least, target)
    return [*found[:-2], (found[-2][0], found[-1][1])] if _short_tail(paragraphs, found, least) else found


def _pieces(paragraphs: list[str], breaks: list[bool], least: int, target: int) -> list[tuple[int, int]]:
    scenes, start, words = [], 0, 0
    for k, p in enumerate(paragraphs):
        n = len(WORD.findall(p))
        if k > start and words >= least and (breaks[k] or words + n > target):
            scenes.append((start, k))
            start, words = k, 0
        words += n
    return [*scenes, (start, len(paragraphs))] if paragraphs else []


def _short_tail(paragraphs: list[str], pieces: list[tuple[int, int]], least: int) -> bool:
    return len(pieces) > 1 and sum(len(WORD.findall(p)) for p in paragraphs[pieces[-1][0] :]) < least


def cut_scenes(text: str, paragraphs: list[str], breaks: list[bool], least: int, target: int) -> list[dict]:
    """Scenes with offsets: each paragraph is looked for after the one before. A scene ends
    where its joined text would, counted from its start, or, if a short last piece joined it,
    where that piece would."""
    starts, at = [], 0
    for p in paragraphs:
        found = text.find(p, at)
        starts.append(found if found >= 0 else at)
        at = starts[-1] + len(p)
    pieces = _pieces(paragraphs, breaks, least, target)
    body = lambda a, b: "\n\n".join(paragraphs[a:b]).strip()
    out = [{"text": body(a, b), "start_char": starts[a], "end_char": starts[a] + len(body(a, b))} for a, b in pieces]
    if _short_tail(paragraphs, pieces, least):
        tail = out.pop()
        out[-1] |= {"text": body(pieces[-2][0], pieces[-1][1]), "end_char": tail["end_char"]}
    return out or [{"text": text, "start_char": 0, "end_char": len(text)}]


def _measured(text: Column) -> Column:
    """What the fold needs of every paragraph: its place in the text, length, words and whether
    it may open a scene. Pieces of white space only are left out."""
    pieces, gaps = F.split(text, r"\n\s*\n"), F.regexp_extract_all(text, F.lit(r"\n\s*\n"), 0)
    lead = lambda x: F.length(F.regexp_extract(x, r"(?U)^\s*", 0))
    each = F.arrays_zip(pieces.alias("raw"), F.transform(gaps, lambda x: F.length(x)).alias("gap"))
    kind = "struct<lead:int,long:int,all:int,words:long,opens:boolean>"
    measure = lambda x, p: F.struct(lead(x["raw"]).alias("lead"), F.length(p).alias("long"), (F.length(x["raw"]) + F.coalesce(x["gap"], F.lit(0))).alias("all"), T.count_words(p).alias("words"), is_scene_break(p).alias("opens")).cast(kind)
    return F.transform(each, lambda x: F.element_at(F.transform(F.array(T.strip(x["raw"])), lambda p: measure(x, p)), 1))


def _packed(measures: Column, least: int, target: int) -> Column:
    """The fold over measured paragraphs: a struct with ``cuts``, (number, place) of every
    paragraph that a scene begins with, how many paragraphs there are, and the words of the last scene."""
    first = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("words"), F.array().cast("array<struct<n:int,at:long>>").alias("cuts"))

    def step(s, x):
        opens = (s["n"] == 0) | ((s["words"] >= least) & (x["opens"] | (s["words"] + x["words"] > target)))
        here = F.struct(s["n"].alias("n"), (s["at"] + x["lead"]).alias("at"))
        full = F.struct((s["n"] + 1).alias("n"), (s["at"] + x["all"]).alias("at"), F.when(opens, x["words"]).otherwise(s["words"] + x["words"]).alias("words"), F.when(opens, F.concat(s["cuts"], F.array(here))).otherwise(s["cuts"]).alias("cuts"))
        blank = F.struct(s["n"].alias("n"), (s["at"] + x["all"]).alias("at"), s["words"].alias("words"), s["cuts"].alias("cuts"))
        return F.when(x["long"] > 0, full).otherwise(blank)

    return F.aggregate(measures, first, step)


def scenes(chapters: DataFrame, least: int = 250, target: int = 1000) -> DataFrame:
    """(book_id, chapter_index, text) -> scenes with offsets and their place in the book.

    A scene ends where its joined text would, counted from its start; a short last one joins the
    one before and gives it its own end. A text without paragraphs is one scene. Chapters are
    packed once, to a written table; scenes are numbered within their chapter, and a book's
    chapters meet by their numbers of scenes only, never by their texts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = chapters.select("book_id", "chapter_index", text.alias("text"), _packed(_measured(text), least, target).alias("p"))
    short = (F.size("p.cuts") > 1) & (F.col("p.words") < least)
    rows = rows.withColumns({"parts": split_paragraphs("text"), "short": short, "n": F.when(short, F.size("p.cuts") - 1).otherwise(F.greatest(F.lit(1), F.size("p.cuts")))})
    body = lambda a, b: F.array_join(F.slice("parts", a + 1, b - a), "\n\n")
    cuts, none = F.col("p.cuts"), F.size("p.cuts") == 0

    def scene(k: Column) -> Column:
        here = F.element_at(cuts, k)
        tail = F.element_at(cuts, -1)
        last = k == F.col("n")
        end = F.when(last, F.col("p.n")).otherwise(F.try_element_at(cuts, k + 1)["n"])
        whole = body(here["n"], end)
        ends = F.when(last & F.col("short"), tail["at"] + F.length(body(tail["n"], F.col("p.n")))).otherwise(here["at"] + F.length(whole))
        return F.struct(whole.alias("text"), here["at"].alias("start_char"), ends.cast("long").alias("end_char"))

    whole = F.array(F.struct(F.col("text"), F.lit(0).cast("long").alias("start_char"), F.length("text").cast("long").alias("end_char")))
    found = F.when(none, whole).otherwise(F.transform(F.sequence(F.lit(1), F.col("n")), scene))
    found = cut(rows.select("book_id", "chapter_index", "n", found.alias("found")))
    before = Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("book_id", "chapter_index").agg(F.sum("n").alias("m"))
    counts = counts.withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    rows = matched(found, counts, ["book_id", "chapter_index"]).select("book_id", "chapter_index", "ahead", F.posexplode("found").alias("k", "s"))
    return rows.select("book_id", "chapter_index", (F.col("k") + 1).alias("scene_index"), "s.text", "s.start_char", "s.end_char", (F.col("ahead") + F.col("k") + 1).cast("int").alias("scene_pos"))


class SceneRows:
    """The table function ``scenes``: a chapter's text -> its scenes."""

    def eval(self, text: str, least: int, target: int):
        parts = [p for p in (x.strip() for x in re.split(r"\n\s*\n", text or "")) if p]
        for k, r in enumerate(cut_scenes(text or "", parts, [bool(_is_break(p)) for p in parts], least, target)):
            yield k + 1, r["text"], r["start_char"], r["end_char"]


def _is_break(paragraph: str) -> bool:
    t = " ".join(paragraph.split())
    return bool(re.search(SCENE_BREAK, t)) or (len(WORD.findall(t)) <= 18 and bool(re.search(TIME_SHIFT, t)))


def register_scenes(spark: SparkSession, name: str = "scenes") -> None:
    """``SELECT ... FROM chapters, LATERAL scenes(text, 250, 1000)``."""
    kind = F.udtf(returnType="scene_index int, text string, start_char long, end_char long", useArrow=True)
    spark.udtf.register(name, kind(SceneRows))


def pack_chunks(paragraphs: list[str], tokens: Callable[[str], list[str]], most: int, overlap: int) -> list[str]:
    """Paragraphs packed to ``most`` tokens; a chunk opens with the last ``overlap`` tokens of
    the one before; an oversize paragraph is cut into overlapping windows."""
    out, now, size = [], [], 0

    def flush() -> None:
        nonlocal now, size
        if now:
            out.append("\n\n".join(now))
        now, size = [], 0

    for p in paragraphs:
        words = tokens(p)
        if len(words) > most:
            flush()
            step = max(1, most - overlap)
            for a in range(0, len(words), step):
                out.append(" ".join(words[a : a + most]))
                if a + most >= len(words):
                    break
            continue
        if now and size + len(words) + 1 > most:
            tail = tokens("\n\n".join(now))[-overlap:] if overlap else []
            flush()
            if tail:
                now, size = [" ".join(tail)], len(tail)
        now.append(p)
        size += len(words) + 1
    flush()
    return out


def _chunked(parts: Column, most: int, overlap: int) -> Column:
    """``pack_chunks`` over tokens of white space, as a fold over the paragraphs."""
    tokens = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    step = max(1, most - overlap)
    none = F.array().cast("array<string>")
    first = F.struct(none.alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("size"))
    flushed = lambda s: F.when(s["now"].isNotNull(), F.concat(s["out"], F.array(s["now"]))).otherwise(s["out"])

    def windows(x):
        n = F.lit(1) + F.ceil((x["n"] - most) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice(x["words"], k * step + 1, most), " "))

    def fold(s, x):
        over = F.struct(F.concat(flushed(s), windows(x)).alias("out"), F.lit(None).cast("string").alias("now"), F.lit(0).alias("size"))
        words = tokens(s["now"])
        tail = F.slice(words, F.greatest(F.lit(1), F.size(words) - overlap + 1), overlap) if overlap else none
        fresh = F.struct(flushed(s).alias("out"), F.when(F.size(tail) > 0, F.concat(F.array_join(tail, " "), F.lit("\n\n"), x["p"])).otherwise(x["p"]).alias("now"), (F.size(tail) + x["n"] + 1).alias("size"))
        more = F.struct(s["out"].alias("out"), F.concat_ws("\n\n", s["now"], x["p"]).alias("now"), (s["size"] + x["n"] + 1).alias("size"))
        return F.when(x["n"] > most, over).when(s["now"].isNotNull() & (s["size"] + x["n"] + 1 > most), fresh).otherwise(more)

    sized = F.transform(parts, lambda p: F.element_at(F.transform(F.array(tokens(p)), lambda w: F.struct(p.alias("p"), w.alias("words"), F.size(w).alias("n"))), 1))
    return F.aggregate(sized, first, fold, flushed)


def chunks(scenes: DataFrame, most: int = 512, overlap: int = 64, tokens: Callable[[str], list[str]] | None = None) -> DataFrame:
    """Scenes -> classifier chunks of at most ``most`` tokens: of white space, in built-in
    functions, or by ``tokens``, a user's tokenizer."""

    @F.pandas_udf("array<string>")
    def packed(parts: pd.Series) -> pd.Series:
        return pd.Series([pack_chunks([] if p is None else list(p), tokens, most, overlap) for p in parts])

    keys = [c for c in ("book_id", "chapter_index", "scene_index") if c in scenes.columns]
    parts = split_paragraphs("text")
    return scenes.select(*keys, F.posexplode(_chunked(parts, most, overlap) if tokens is None else packed(parts)).alias("chunk_index", "text"))


def sentence_chunks(text: Column | str, most: int = 1500) -> Column:
    """Sentences packed, in order, to chunks of at most ``most`` characters."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.filter(F.split(c, r"(?<=[.!?…])\s+"), lambda x: x != "")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    fits = lambda a, x: (F.size(a) > 0) & (F.length(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))) + 1 + F.length(x) <= most)
    step = lambda a, x: F.when(fits(a, x), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last(a), F.lit(" "), x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def translated(books: DataFrame, translate: Callable[[list[str]], list[str]], most: int = 1500) -> DataFrame:
    """(book_id, text) -> text through ``translate`` chunk by chunk, reassembled in order; a null
    text is an empty one."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return pd.Series(translate(c.tolist()))

    parts = books.select("book_id", F.posexplode_outer(F.split("text", "\n\n")).alias("p", "part"))
    pieces = parts.select("book_id", "p", F.posexplode_outer(sentence_chunks("part", most)).alias("c", "piece"))
    done = pieces.withColumn("piece", F.when(F.col("piece").isNotNull(), run(F.coalesce("piece", F.lit("")))).otherwise(""))
    join = lambda key, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), sep)
    whole = done.groupBy("book_id", "p").agg(join("c", "piece", " ").alias("part")).groupBy("book_id").agg(join("p", "part", "\n\n").alias("text"))
    return whole.withColumn("text", T.normalize_headings("text"))


def routed(books: DataFrame, translate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Books in the script of ``ru`` go through ``translate``, others, also those without a text, pass."""
    b = books.withColumn("source_language", F.coalesce(T.detect_language("text"), F.lit("en")))
    ru = b.where("source_language = 'ru'")
    done = translated(ru, translate).withColumns({"source_language": F.lit("ru"), "translated": F.lit(True)})
    other = b.where("source_language != 'ru'").select("book_id", "text", "source_language").withColumn("translated", F.lit(False))
    return done.select("book_id", "text", "source_language", "translated").unionByName(other)

"""Boundary cases of the line, segment, context and job rules."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import context as C
from folioscope.operators import headings as H
from folioscope.operators import jobs as J
from folioscope.operators import layout as L
from folioscope.operators import scoring as S
from folioscope.operators import segment as G
from folioscope.sources import books as B


def values(spark, fn, items):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(items)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(fn("x")).collect()]


def test_formats_and_flags(spark):
    assert values(spark, T.detect_format, ["book.TXT", "archive.Pdf", "without_ext", "chapter.v1.txt"]) == ["txt", "pdf", "", "txt"]
    assert values(spark, T.parse_flag, ["1", "true", "TRUE", "on", " yes ", "", "0", "false", "no", "anything", None]) == [True] * 5 + [False] * 6


def test_decoding(spark):
    df = spark.createDataFrame([("Привет, мир".encode(),), (bytes.fromhex("cff0e8e2e5f2"),), (None,)], "content binary")
    assert [r.text for r in B.decoded(df).collect()] == ["Привет, мир", "Привет", None]


def test_whitespace(spark):
    assert values(spark, T.clean_line, ["  a b­ \t c ", "", None]) == ["a b c", "", None]
    assert values(spark, T.counting_key, ["— Page X —", "_A_"]) == ["page x", "a"]


def test_headings(spark):
    assert values(spark, T.is_structured_heading, ["Chapter IV", "Chapter one: X", "- chapter 3 -", "Chapters", "Prologue", "mild"]) == [True, True, True, False, True, False]
    assert values(spark, T.is_page_number, ["12", "page 3", "3 of 9", "3/9", "civil", "", "12345"]) == [True, True, True, False, True, True, False]
    assert values(spark, T.is_front_heading, ["Preface", "preface to the long story of it all", "Index"]) == [True, False, False]
    assert values(spark, T.candidate_kind, ["Contents", "Notes", "Chapter 1"]) == ["front", "back", "chapter"]
    assert values(spark, T.is_heading_line, ["Copyright 1999", "The Long Road", "it went on."]) == [False, True, False]
    with pytest.raises(ValueError):
        T.matches_optional(F.col("x"), "(")


def test_excerpt_and_language(spark):
    assert values(spark, lambda c: T.excerpt(c, 7), ["one two three", "short"]) == ["one...", "short"]
    assert values(spark, T.detect_language, ["Привет мир", "hello", "", None]) == ["ru", "en", "en", "en"]
    assert values(spark, T.normalize_headings, ["Chapter one, The Sea"]) == ["Chapter one. The Sea"]


@pytest.mark.parametrize(("lines", "parts"), [(139, True), (140, False)])
def test_paragraph_gap_of_txt(spark, lines, parts):
    text = "\n".join(["first", "", *["line"] * (lines - 3), "last"])
    df = L.txt_lines(spark.createDataFrame([("b", text)], "book_id string, text string"))
    assert (L.paragraphs(df).count() == 2) == parts


def test_hyphens(spark):
    df = L.txt_lines(spark.createDataFrame([("b", "won-\nderful\nday-\nLight")], "book_id string, text string"))
    assert L.paragraphs(df).first().text == "wonderful day- Light"


def test_repeated_header_needs_three_pages(spark):
    def book(pages):
        rows = [("b", p, k, t, 30.0 + 18 * k, 42.0 + 18 * k, 800.0) for p in range(1, 21) for k, t in enumerate((["Running Head"] if p <= pages else []) + [f"body {p} {j} text" for j in range(10)])]
        return spark.createDataFrame(rows, "book_id string, page_num int, line_no int, text string, y0 double, y1 double, page_height double")

    assert [r.norm for r in L.repeated_edges(book(3)).collect()] == ["running head"]
    assert L.repeated_edges(book(2)).collect() == []


def test_chapters_are_found(spark):
    body = "It was a long and quiet day in the country, and nobody had much to say about anything at all."
    text = "\n".join(["Chapter 1", *[body] * 8, "Chapter 2", *[body] * 8])
    found = H.detect(L.txt_lines(spark.createDataFrame([("b", text)], "book_id string, text string")))
    rows = sorted(found.chapters.collect(), key=lambda r: r.chapter_index)
    assert [r.chapter_title for r in rows] == ["Chapter 1", "Chapter 2"]
    assert all(r.text.count("quiet day") == 8 for r in rows)


BODY = "It was a long and quiet day in the country, and nobody had much to say about anything at all."


def test_back_matter_before_the_first_chapter_loses_no_text(spark):
    """On one page a back heading ends the body wherever it is; the book then is one chapter."""
    text = "\n".join(["Notes", *[BODY] * 3, "Chapter 1", *[BODY] * 8, "Chapter 2", *[BODY] * 8])
    books = spark.createDataFrame([("b", text), ("e", " \n "), (None, text)], "book_id string, text string")
    found = H.detect(L.txt_lines(books)).chapters
    rows = {r.book_id: r for r in H.with_fallback(books, found).collect()}
    assert set(rows) == {"b", None} and all(r.fallback_single_chapter and r.text == text for r in rows.values())
    kept = H.detect(L.txt_lines(books.where("book_id = 'b'")), keep_back=True).chapters
    assert sorted(r.chapter_title for r in kept.collect()) == ["Chapter 1", "Chapter 2"]


def test_back_matter_late_in_a_book_ends_it(spark):
    def page(p, texts):
        return [("b", p, k, t, 50.0, 550.0, 30.0 + 18 * k, 42.0 + 18 * k, 12.0, 600.0, 800.0) for k, t in enumerate(texts)]

    pages = [["Notes", BODY]] + [[f"Chapter {k}", *[BODY] * 6] for k in range(1, 9)] + [["Notes", BODY]]
    rows = [r for p, texts in enumerate(pages, 1) for r in page(p, texts)]
    lines = spark.createDataFrame(rows, "book_id string, page_num int, line_no int, text string, x0 double, x1 double, y0 double, y1 double, font_size double, page_width double, page_height double")
    d = H.detect(lines)
    w = d.window.first()
    assert (w.start_idx, w.end_idx, w.start_reason, w.end_reason) == (2, 57, "first-chapter-candidate", "first-back-matter-candidate-after-body")
    assert d.chapters.count() == 8
    with pytest.raises(ValueError):
        H.detect(lines, max_chapters=0)
    with pytest.raises(Exception, match="Expected 3 chapters, detected 8"):
        H.expected_count(d, 3, strict=True).collect()


def test_page_numbers_are_removed_and_listed(spark):
    rows = [("b", p, k, t, 50.0, 550.0, y, y + 12, 12.0, 600.0, 800.0) for p in range(1, 6) for k, (t, y) in enumerate([("some body text " * 8, 300.0), (str(p), 780.0)])]
    rows += [("b", 9, 0, "IV", 50.0, 550.0, 30.0, 50.0, 20.0, 600.0, 800.0), ("b", 9, 1, BODY, 50.0, 550.0, 60.0, 72.0, 12.0, 600.0, 800.0), ("b", 9, 2, BODY, 50.0, 550.0, 90.0, 102.0, 12.0, 600.0, 800.0)]
    lines = spark.createDataFrame(rows, "book_id string, page_num int, line_no int, text string, x0 double, x1 double, y0 double, y1 double, font_size double, page_width double, page_height double")
    assert [r.preview for r in L.removed_preview(lines).orderBy("rank").collect()] == [f"{p} (x1)" for p in range(1, 6)]
    assert {r.text for r in L.without_edges(lines).where("page_num = 9").collect()} == {"IV", BODY}  # a large number in the middle of the top


def test_scene_offsets_move_past_every_paragraph():
    ps = ["a b", "x", "x", "q r s", "x"]
    found = G.cut_scenes("\n\n".join(ps), ps, [False] * 5, 3, 3)
    assert [(r["start_char"], r["end_char"]) for r in found] == [(0, 6), (8, 19)]
    tail = G.cut_scenes("a b c\n\n\n\nd", ["a b c", "d"], [False, False], 3, 3)
    assert tail == [{"text": "a b c\n\nd", "start_char": 0, "end_char": 10}]


def test_plain_text(spark):
    lines = spark.createDataFrame([("b", 1, 0, "won-"), ("b", 1, 1, "Derful day"), ("b", 1, 2, "12"), ("b", 2, 0, "end")], "book_id string, page_num int, line_no int, text string")
    assert L.plain_text(lines).first().text == "wonDerful day\n\nend"


def test_outputs_are_replaced_and_removed(spark, tmp_path):
    from folioscope.sources import sinks as K

    df = spark.createDataFrame([("a", 1, "One", "x"), ("b", 1, "Two é", "y")], "book_id string, chapter_index int, chapter_title string, text string")
    K.write_stage(df, str(tmp_path), "scenes")
    K.write_stage(df.where("book_id = 'a'").withColumn("text", F.lit("new")), str(tmp_path), "scenes")
    assert {(r.book_id, r.text) for r in spark.read.parquet(f"{tmp_path}/scenes").collect()} == {("a", "new"), ("b", "y")}
    K.write_texts(df, f"{tmp_path}/chapter_texts")
    assert {(r.name, r.value) for r in spark.read.text(f"{tmp_path}/chapter_texts").collect()} == {("chapter_001_One", "x"), ("chapter_001_Two_", "y")}
    K.write_csv(df, f"{tmp_path}/other")
    assert sorted(K.clean_outputs(spark, str(tmp_path))) == [f"{tmp_path}/chapter_texts", f"{tmp_path}/scenes"] and (tmp_path / "other").exists()


def test_scene_packing():
    words = lambda n: " ".join(["w"] * n)
    ps = [words(300), "* * *", words(300), words(100)]
    assert G.pack_scenes(ps, [False, True, False, False], 250, 1000) == [(0, 1), (1, 4)]
    assert G.pack_scenes([words(300), words(900), words(10)], [False] * 3, 250, 1000) == [(0, 1), (1, 3)]
    assert G.pack_scenes([], [], 250, 1000) == []


def test_chunk_packing():
    assert G.pack_chunks(["a b c", "d e f"], str.split, 5, 1) == ["a b c", "c\n\nd e f"]
    assert G.pack_chunks(["a b c d e f g"], str.split, 4, 1) == ["a b c d", "d e f g"]


def test_scenes_offsets(spark):
    df = spark.createDataFrame([("b", 1, "one two\n\nthree four"), ("b", 2, None)], "book_id string, chapter_index int, text string")
    rows = sorted(G.scenes(df, 1, 2).collect(), key=lambda r: r.scene_pos)
    assert [(r.text, r.start_char, r.end_char) for r in rows] == [("one two", 0, 7), ("three four", 9, 19), ("", 0, 0)]


def test_translation_keeps_blank_paragraphs_and_order(spark):
    df = spark.createDataFrame([("b", "Привет мир. Ещё.\n\n\n\nКонец.")], "book_id string, text string")
    row = G.routed(df, lambda xs: [x.upper() for x in xs]).first()
    assert (row.text, row.translated) == ("ПРИВЕТ МИР. ЕЩЁ.\n\n\n\nКОНЕЦ.", True)


def test_names(spark):
    df = spark.createDataFrame([(1, "Dr. Smith met Anna. Anna said The end to Dr. Smith and Bob.")], "k int, text string")
    rows = sorted(C.names(df, ["k"]).collect(), key=lambda r: r["rank"])
    assert [(r.name, r.n) for r in rows] == [("Dr. Smith", 2), ("Anna", 2), ("Bob", 1)]


def test_approval(spark):
    assert values(spark, lambda c: C.has_approval(F.col(c)), ["I approve", "I do not approve", "well done", "nothing"]) == [True, False, True, False]


def test_replies(spark):
    cases = [json.dumps({"summary": "s", "characters": "Ann", "speaker_emotions": {"Ann": ["joy"]}, "narrator_tone": {"x": 1}}), "not json", None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, r string").select("k", C.reply_context(F.col("r")).alias("c"))
    rows = [r.c for r in df.orderBy("k").collect()]
    assert rows[0].characters == ["Ann"] and rows[0].character_emotions == {"Ann": ["joy"]} and rows[0].narrator_tone == []
    assert rows[1] is None and rows[2] is None


def test_correction_is_off_without_approval(spark):
    df = spark.createDataFrame([({"approval": 0.0, "joy": 0.4, "sadness": 0.9},)], "s map<string,double>")
    out = df.select(S.correct(F.col("s"), F.lit("compassion"), F.array(F.lit("tragic")), F.lit(False), F.lit(True)).alias("s")).first().s
    assert out == {"approval": 0.0, "joy": 0.4, "sadness": 0.9}


def test_scorer_plug_in(spark):
    score = S.scorer(["a", "b"], lambda: lambda xs: [[float(len(x)), 0.0] for x in xs])
    df = spark.createDataFrame([("xx",), (None,)], "t string")
    assert [r.s for r in df.select(score("t").alias("s")).collect()] == [{"a": 2.0, "b": 0.0}, {"a": 0.0, "b": 0.0}]


def test_latest_status_breaks_ties_by_rank(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("j", t, "processing"), ("j", t, "completed"), ("j", t, "pending"), ("k", t, "pending")]
    got = {r.job_id: r.status for r in J.latest(spark.createDataFrame(rows, "job_id string, updated_at timestamp, status string")).collect()}
    assert got == {"j": "completed", "k": "pending"}


def test_uploads(spark):
    rows = [("u", None, "a.txt", b"x", None), ("", "t", "a.txt", b"", "PDF")]
    got = J.validated(spark.createDataFrame(rows, "user_id string, title string, filename string, content binary, format string")).collect()
    assert (got[0].errors, got[0].title, got[0].format) == ([], "a.txt", "txt")
    assert len(got[1].errors) == 2 and got[1].format == "pdf"

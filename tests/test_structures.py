"""Operators that replace a fold, a group buffer or a loop, against plain versions of it."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import asof, headings, quantile, segment

CANDIDATES = "book_id string, page_num int, norm string, start_global int, end_global int, title string, score double"


def plain(rows, clash):
    kept = []
    for x in rows:
        if kept and clash(kept[-1], x):
            if x[6] > kept[-1][6]:
                kept[-1] = x
        else:
            kept.append(x)
    return kept


def overlaps(rows):
    out = []
    for key in sorted({r[:2] for r in rows}, key=str):
        page = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], -r[6], r[2], r[4]))
        out += plain(page, lambda last, x: x[3] <= last[4])
    return out


def titles(rows):
    out = []
    for book in sorted({r[0] for r in rows}, key=str):
        out += plain(sorted((r for r in rows if r[0] == book), key=lambda r: r[3]), lambda last, x: last[2] == x[2] and x[1] - last[1] <= 1)
    return out


def made(seed, n, lines, book="b", titles_of=4):
    """Groups of up to five lines, several from one line, on pages of ``lines`` lines; few scores, so many tie."""
    rng, out, at = random.Random(seed), {}, 0
    while len(out) < n:
        at += rng.choice([0, 0, 1, 1, 1, 2, 7])
        page, line = divmod(at, lines)
        end = min(at + rng.randrange(5), page * lines + lines - 1)
        out[at, end] = (book, page + 1, f"t{rng.randrange(titles_of)}", at, end, "T", rng.choice([5.0, 6.0, 7.0, 7.5]))
    return list(out.values())


@pytest.mark.parametrize("run", [7, 256])
def test_overlaps_are_resolved_as_by_a_loop(spark, run):
    rows = made(1, 400, 30) + made(2, 300, 10_000, None) + made(3, 1, 5, "one")
    df = spark.createDataFrame(rows, CANDIDATES)
    got = sorted((tuple(r) for r in headings.apart(df, ["book_id", "page_num"], run).collect()), key=str)
    assert got == sorted(overlaps(rows), key=str)
    assert headings.apart(df.limit(0), ["book_id", "page_num"]).count() == 0


def test_equal_titles_are_resolved_as_by_a_loop(spark):
    rows = overlaps(made(4, 500, 3, titles_of=2) + made(5, 300, 9, None, 3) + made(6, 200, 1000, "flat", 2))
    got = sorted((tuple(r) for r in headings.retitled(spark.createDataFrame(rows, CANDIDATES)).collect()), key=str)
    assert got == sorted(titles(rows), key=str)


def test_a_book_of_a_hundred_thousand_candidates(spark):
    rows = made(7, 100_000, 400_000)
    got = headings.resolved(spark.createDataFrame(rows, CANDIDATES))
    want = titles(overlaps(rows))
    assert sorted(r.start_global for r in got.select("start_global").collect()) == [r[3] for r in want]


def test_medians_equal_the_built_in_and_keep_null_keys(spark):
    rng = random.Random(3)
    rows = [("a", "x", rng.random()) for _ in range(501)] + [("a", "y", round(rng.random(), 1)) for _ in range(400)] + [(None, "x", float(k)) for k in range(6)]
    rows += [("c", None, 1e300), ("c", None, 1e-300), ("c", None, -5.0), ("d", "x", None), ("e", "x", 2.0), ("e", "x", 2.0), ("f", "x", -1e18), ("f", "x", 1.0)]
    df = spark.createDataFrame(rows, "k string, l string, v double")
    want = {tuple(r) for r in df.groupBy("k", "l").agg(F.median("v").alias("m")).where("m IS NOT NULL").collect()}
    for bins in (2, 1024):
        assert {tuple(r) for r in quantile.exact_medians(df, ["k", "l"], "v", bins).collect()} == want
    assert quantile.exact_medians(df.limit(0), ["k", "l"], "v").count() == 0


def test_the_last_mark_is_carried_over_ranges(spark):
    rng = random.Random(5)
    rows = [(b, k, f"line {k}") for b in ("a", None, "c") for k in range(200)]
    marks = [(b, k, f"m{k}", rng.randrange(9)) for b in ("a", None) for k in rng.sample(range(200), 7)]
    got = asof.with_last(spark.createDataFrame(rows, "b string, at int, text string"), spark.createDataFrame(marks, "b string, at int, title string, n int"), ["b"], "at", ["title", "n"], "mark", 16)
    for r in got.collect():
        before = [m for m in marks if m[0] == r.b and m[1] <= r.at]
        assert r.text == f"line {r.at}" and (r.mark["title"] if r.mark else None) == (max(before, key=lambda m: m[1])[2] if before else None)
    assert got.count() == len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "beta's", "über", "x-y", "—", "later", "chapter 1"])
    for _ in range(60):
        paragraphs = [rng.choice(["* * *", "Monday it rained", " ".join(word() for _ in range(rng.randrange(40)))]) for _ in range(rng.randrange(12))]
        yield rng.choice(["", "\n\n", "  "]) + rng.choice(["\n\n", "\n \t\n", "\n\n\n"]).join(paragraphs) + rng.choice(["", "\n", "  "])


def test_scenes_are_packed_as_by_a_loop(spark):
    rows = [(1, k, t) for k, t in enumerate(texts(9))] + [(1, 100, None), (None, 1, "one\n\ntwo")]
    got = segment.scenes(spark.createDataFrame(rows, "book_id int, chapter_index int, text string"), 20, 60)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.scene_index):
        found.setdefault((r.book_id, r.chapter_index), []).append((r.text, r.start_char, r.end_char))
    for book, chapter, text in rows:
        parts = [p for p in (x.strip() for x in __import__("re").split(r"\n[ \t\n\x0b\f\r]*\n", text or "")) if p]
        want = segment.cut_scenes(text or "", parts, [segment._is_break(p) for p in parts], 20, 60)
        assert found[book, chapter] == [(w["text"], w["start_char"], w["end_char"]) for w in want]


def test_chunks_are_packed_as_by_a_loop(spark):
    rows = [(1, 1, k, t) for k, t in enumerate(texts(10))]
    df = spark.createDataFrame(rows, "book_id int, chapter_index int, scene_index int, text string")
    for most, overlap in ((10, 3), (25, 0), (5, 5), (64, 16)):
        native, python = segment.chunks(df, most, overlap), segment.chunks(df, most, overlap, str.split)
        assert "Python" not in native._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, native.collect())) == sorted(map(tuple, python.collect()))


def test_the_gap_after_the_last_line_is_no_gap(spark):
    from folioscope.operators import layout

    rows = [("a", 1, k, float(y), y + 12.0, 12.0) for k, y in enumerate((30, 48, 90))] + [("b", 1, 0, 30.0, 42.0, 0.0)]
    df = spark.createDataFrame(rows, "book_id string, page_num int, line_no int, y0 double, y1 double, font_size double")
    got = {r.book_id: (r.median_font, r.median_gap) for r in layout.page_medians(df).collect()}
    assert got == {"a": (12.0, 18.0), "b": (12.0, 8.0)}


def test_a_null_score_stays_null(spark):
    from folioscope.operators import scoring

    rows = [("a", 1, 1, "joy", 0.4), ("a", 1, 2, "joy", None), (None, 1, 1, "joy", 0.5), ("b", 1, 1, "joy", None), ("b", 1, 1, "neutral", None)]
    df = spark.createDataFrame(rows, "book_id string, chapter_index int, scene_index int, label string, score double")
    got = sorted((str(r.book_id), r.scene_index, r.label, r.score) for r in scoring.calibrate(df).collect())
    assert got == [("None", 1, "joy", 0.393939), ("a", 1, "joy", 0.302326), ("a", 2, "joy", None), ("b", 1, "joy", None), ("b", 1, "neutral", None)]

"""Queries against their SQL on documents made for the rules in which the two once differed."""

import duckdb
import pytest
from test_oracle import plain

import folioscope.plans.books  # noqa: F401
from folioscope.plans.registry import QUERIES, SQL


def compared(spark, folder, name, texts, source=lambda k: "s"):
    """Rows of Spark and of the SQL over these texts as documents."""
    rows = [(k, t, "en", source(k), len(t or "")) for k, t in enumerate(texts, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    cols = ", ".join(sorted(df.columns))
    return plain(tuple(r) for r in df.select(*sorted(df.columns)).collect()), plain(con.execute(f"SELECT {cols} FROM ({SQL[name]})").fetchall())


NAMED = [
    "AKIAPTDW7QX and Anna", "xAnna _Bell \u00e9Carl 7Dora", "Anna- Bell' An- Carl-Dora", "Dr\u00a0Anna Mr.\tBell Mrs\x0bCarl Doctor Dora", "Annae\u0301 \u0301Bell Carl\u00b2 \u00b2Dora", "Anna\u0416 Bell\u0444 Carl_", None, "",
]


def test_names_end_with_their_letters(spark, tmp_path):
    got, want = compared(spark, tmp_path, "character_names", NAMED)
    assert got == want
    assert [r for r in got if r[0] == 1] == [(1, 1, "AKIAPTDW", 1), (1, 1, "Anna", 2)]


def test_flags_are_in_lower_case(spark, tmp_path):
    words = ["On the road", "on the road", "TRUE story", "true story", "Yes sir", "yes sir", "1 day", None, ""]
    texts = [w for w in words for _ in range(8)]  # the eighth kind of title is a text's first two words
    got, want = compared(spark, tmp_path, "title_texts", texts)
    assert got == want
    assert {r[1] for r in got if r[0] % 8 == 7 and r[2]} == {"on the", "true story", "yes sir", "1 day"}


def test_numbers_of_four_digits_head_chapters(spark, tmp_path):
    got, want = compared(spark, tmp_path, "contents_titles", [f"word {k} of a short line" for k in range(1003)])
    assert got == want
    assert len(got) == 1003 and ("s", 1002, "Chapter 1002: Document 1002") in {r[:3] for r in got}

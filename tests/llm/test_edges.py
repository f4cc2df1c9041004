"""Every operator's query and every pipeline stage over odd tables: null ids, texts and
labels, repeated rows, an id with two texts, empty and very long texts, columns whose names
clash with the operators' own, and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm.queries import QUERIES

CLASH = "mix_size mix_source mix_source_size mix_target mix_copies copy_no kept_text key t sid n none at hash h label score stat n_found digest first t1 t2 id".split()


def documents():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choices(vocabulary, k=k)) + ".\n" + " ".join(rng.choices(vocabulary, k=k))
    rows = [(k, prose(60), "en" if k % 2 else "fr", f"s{k % 3}") for k in range(40)]
    rows += [(None, prose(50), "en", "s1"), (None, None, None, None), (None, prose(50), "fr", None), (50, None, "en", "s2"), (51, "", "en", "s2"), (52, "  \n\t ", None, "s2"), (53, "12 3 !", "fr", "s0")]
    rows += [rows[3], rows[3], (3, prose(40), "en", "s0"), (60, rows[5][1], "fr", "s2"), (61, rows[5][1] + " more", "fr", "s2")]
    rows += [(70, prose(40_000), "en", "s0"), (71, "x" * 300_000, None, "s1"), (72, "mail a.b@c.org on 2024-02-03, 212-555-0100", "en", "s1")]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    extra = {c: F.lit("clash") for c in CLASH}
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.withColumns(extra).write.parquet(f"{root}/documents.parquet")
    pages = [(r[0], f"u{r[0]}", r[1]) for r in documents()]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: v for c, v in extra.items()}).write.parquet(f"{root}/pages.parquet")
    items = [(1, " ".join(documents()[2][1].split()[5:25])), (2, None), (3, ""), (None, "never found in any of these texts at all"), (1, "x y")]
    spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "n": F.lit(2), "s": F.lit(3)}).write.parquet(f"{root}/benchmark.parquet")
    turns = [(r[0], k % 7 if k % 11 else None, r[2], r[1]) for k, r in enumerate(documents())]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns(extra).write.parquet(f"{root}/conversations.parquet")
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(45)] + [(None, 1, 1), (5, None, None), (7, 1, 0), (999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"key": F.lit(1), "label": F.lit("x"), "text": F.lit("y")}).write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    got = QUERIES[name](spark, odd).collect()
    if name == "op6_benchmark_decontamination":
        assert {(r.doc_id, r.item_id) for r in got} == {(2, 1)}
        return
    if name == "op11_phrase_collocations":
        assert {r.lang for r in got} <= {"en", "fr", "und"} and all(r.a >= 100 for r in got)
        return
    if name == "op13_conversation_repair":
        assert sorted((r.conv_id for r in got), key=str) == sorted({r[0] for r in documents()}, key=str)
        return
    key = "page_id" if name.startswith("op4") else "doc_id"
    assert Counter(r[key] for r in got) == Counter(r[0] for r in documents())
    for r in got:
        if "score" in r:
            assert 0 <= r.score <= 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd)
    assert got.columns[:5] == corpus_pipeline.COLUMNS
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    known = {r[0] for r in documents()}
    assert set(ids) <= known
    if name == "pii":
        assert sum(ids.values()) == len(documents())
    if name == "near_duplicates":
        assert ids[60] == 0 and ids[61] == 0 and ids[3] == 2 and {5, 50, 51, 52, 53, 70, 71, 72} <= set(ids)
    if name == "decontamination":
        assert known - set(ids) == {2}
    assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).collect() == []

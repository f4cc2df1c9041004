"""Archives, pseudonyms, mixing, classifiers and the pipeline."""

import hashlib
import re

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import language, mixing, pii, quality, toxicity, warc
from folioscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_archive_round_trip(spark):
    long = "<p>" + "x" * 200
    rows = [(3, "u", long, 1), (1, None, long, 1), (2, "v\r\nX: y", "short", 1), (4, "w", "short", 1), (5, "w", None, 1), (None, "n", long, 1)]
    stored = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest int")).cache()
    got = {r.page_id: r for r in warc.records(stored).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 1)}
    assert bytes(got[1].payload).decode() == long and got[3].payload is None and got[5].payload_bytes == 0
    assert got[3].payload_digest == hashlib.sha256(long.encode()).hexdigest()
    for b in {r.bundle for r in stored.collect()}:
        frames = [bytes(r.data) for r in stored.where(F.col("bundle") == b).orderBy("seq").collect()]
        sizes = warc.read_seek_table(b"".join(frames))
        assert [c for c, _ in sizes] == [len(f) for f in frames[:-1]]
        assert [d for _, d in sizes] == [len(zstandard.ZstdDecompressor().decompress(f)) for f in frames[:-1]]
    assert [r.page_id for r in warc.fetch(stored, spark.createDataFrame([(3,)], "page_id long")).collect()] == [3]
    assert warc.records(warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    texts = ["card 4041-8949-7460-8795 and 4041894974608795", "bad 4041894974608796", "on 2024-02-29 and 2024-02-30", "ip 10.0.0.1 and 999.1.1.1", "a.b@c.org", "+1 (988) 555-2485", None, "", "none 12 here"]
    df = spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)], "doc_id int, text string, n_found string")
    got = [r.text for r in pii.pseudonymised(df, "k").orderBy("doc_id").collect()]
    a, b = re.findall(r"[\d-]{16,19}", got[0])
    assert a.replace("-", "") == b and b != "4041894974608795" and luhn(b) and a[4] == "-"
    assert got[1] == texts[1] and got[6] is None and got[7] == "" and got[8] == texts[8]
    assert re.fullmatch(r"on \d{4}-\d\d-\d\d and 2024-02-30", got[2]) and "2024-02-29" not in got[2]
    assert "999.1.1.1" in got[3] and "10.0.0.1 " not in got[3] and "@example.invalid" in got[4] and "555-2485" not in got[5]


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pii.permuted_digits(F.col("d"), "x", "k").alias("p")).distinct().count() == 1000


def test_mixing(spark):
    rows = [(k, "w " * (k % 7), s, 0) for k, s in enumerate(["a", "b", "c", None] * 50)] + [(999, None, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size int")
    sizes = mixing.mix(df).collect()
    total = sum(r.mix_size for r in sizes)
    targets = {r.source: (r.mix_target, r.mix_source_size) for r in sizes}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    assert all(t <= 3 * s + 1e-9 for t, s in targets.values()) and all(r.mix_copies <= 3 for r in sizes)
    assert sorted(map(str, sizes)) == sorted(map(str, mixing.mix(df).collect()))
    assert mixing.mix(df.limit(0)).collect() == []


def test_segments_are_maximal():
    assert toxicity.segments([4.0, 3.0, 1.0], [0.0, -1.0, -9.0]) == [(0, 1, 6.0), (2, 2, 1.0)]
    assert toxicity.segments([], []) == []


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.8), ("op8_line_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    got = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    one, zero = got[got[label] == 1].score.to_numpy(), got[got[label] == 0].score.to_numpy()
    auc = ((one[:, None] > zero[None]).mean()) + ((one[:, None] == zero[None]).mean()) / 2
    assert auc >= least and ((got.score >= 0) & (got.score <= 1)).all()


def test_languages(spark):
    got = QUERIES["op10_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    model = language.build({"x": [b"abc abd"], "y": [b"zzz zzy"]})
    assert language.predict(model, ["abc", "zzz", None, "12 3", ""])[0] == ["x", "y", "und", "und", "und"]


def test_models_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.learn(docs, none)).collect()} == {0.5}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and 0.8 * docs.count() < kept.count() < docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]

"""Every stage of the corpus pipeline against SQL on what its predecessor kept."""

import duckdb

import corpus_pipeline as cp
from folioscope.llm import toxicity
from folioscope.llm.pii import pseudonymised
from folioscope.llm.queries import SQL, SQL_MIX, pii_key
from folioscope.llm.tables import table, written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS FROM '{SF}/benchmark.parquet'")
    docs, kept = table(spark, SF, "documents"), []
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == cp.COLUMNS
        kept.append(docs.toPandas())
    clean, single, fresh, private = kept

    start = table(spark, SF, "documents")
    model = toxicity.learn(start, table(spark, SF, "labels"))
    scored = toxicity.score(start, model, spans=False).select("doc_id", "predicted").toPandas()
    assert scored.predicted.sum() > 0
    assert sorted(clean.doc_id) == sorted(scored.doc_id[scored.predicted == 0])

    db.register("documents", clean)
    lows = db.execute(f"SELECT doc_id FROM ({SQL['op1_ngram_jaccard_join']}) WHERE doc_id = component_id").fetchall()
    assert sorted(single.doc_id) == sorted(x for (x,) in lows)

    db.unregister("documents")
    db.register("documents", single)
    leaks = {x for (x,) in db.execute(f"SELECT DISTINCT doc_id FROM ({SQL['op6_benchmark_decontamination']})").fetchall()}
    assert set(fresh.doc_id) == set(single.doc_id) - leaks

    want = pseudonymised(spark.createDataFrame(fresh[["doc_id", "text"]]), pii_key(spark)).toPandas().set_index("doc_id").text
    assert private.set_index("doc_id").text.to_dict() == want.to_dict()

    db.register("private", private)
    sql = f"WITH {SQL_MIX.format(docs='private')} SELECT doc_id, (floor(rate) + (u < rate - floor(rate))::INT)::BIGINT AS n FROM mixed"
    wanted = {d: n for d, n in db.execute(sql).fetchall() if n}
    got = cp.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in got} == wanted

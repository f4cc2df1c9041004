"""One row of each group, whatever the ids."""

from folioscope.llm import ngram_join


def test_ids_that_are_null_or_repeat(spark):
    base = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcd"]
    rows = [(None, base[0]), (None, base[0] + " x"), (None, base[0] + " y"), (None, base[0])]
    rows += [(5, base[1]), (7, base[2]), (7, base[1] + " x"), (8, base[2] + " y")]  # 7 has two texts; one is a near copy of 5's
    rows += [(9, base[3]), (9, base[3] + " z"), (None, "..."), (None, None), (3, None), (3, None)]
    got = [tuple(r) for r in ngram_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    nulls = [t for k, t in got if k is None and t and t.startswith("a")]
    nines = [t for k, t in got if k == 9]
    assert len(nulls) == 1 and len(nines) == 1
    assert sorted((k, t) for k, t in got if k in (5, 7, 8)) == [(5, base[1]), (7, base[2])]
    assert len(got) == 7 and {(None, "..."), (None, None), (3, None)} <= set(got)

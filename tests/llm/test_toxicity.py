"""Log-odds of all tokens, and labels by one plan."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import toxicity
from folioscope.llm import words as W


def test_every_token_has_its_log_odds(spark):
    texts = [("the bad day " + "awful " * (k % 3) + f"t{k}", 1) for k in range(40)] + [(f"the good day day c{k}", 0) for k in range(400)]
    lex = toxicity.lexicon(spark.createDataFrame(texts, "text string, label int"))
    held = [({*text.split()}, label) for text, label in texts]
    of = {w: [sum(w in words for words, y in held if y == label) for label in (0, 1)] for w in {w for words, _ in held for w in words}}
    n = [sum(c[label] for c in of.values()) for label in (0, 1)]
    share = n[1] / sum(n)
    names = [*sorted(of), "unseen"]
    got = lex.scores[toxicity.classes(toxicity.tokens(*W.flat(pa.array([" ".join(names)]))).hash)] / toxicity.UNIT
    for name, score in zip(names, got, strict=True):
        zeros, ones = of.get(name, (0, 0))
        want = math.log(ones / share + toxicity.PRIOR) - math.log(zeros / (1 - share) + toxicity.PRIOR) + toxicity.DRIFT
        assert abs(score - want) <= 0.5 / toxicity.UNIT + 1e-9, name
    by = dict(zip(names, got, strict=True))
    assert by["good"] < by["c1"] <= by["unseen"] == toxicity.DRIFT < by["t1"] < by["bad"]


def test_equal_texts_have_equal_scores_wherever_they_are():
    rng = np.random.default_rng(1)
    lex = toxicity.Lexicon(rng.integers(-3000, 2000, 1 << toxicity.BITS).astype(np.int16), 1.0, 1.0)
    text = " ".join(f"w{k}" for k in rng.integers(0, 400, 900))
    stat, length, spans = toxicity._statistics(lex, pa.array(["x", text, "", None, "y " * 700, text]), True)
    assert stat[1] == stat[5] and spans[1] == spans[5] and list(length) == [1, 900, 0, 0, 700, 900]


def test_labels_are_joined_by_one_plan(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    named = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (9, 1)], "key long, label int")
    got = toxicity.labelled(docs, named)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 0), (2, "b", 0), (2, "b", 1), (2, "c", 0), (2, "c", 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

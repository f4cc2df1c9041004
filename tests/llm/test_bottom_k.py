"""Near duplicates by bottom-k sketches against all pairs of sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bottom_k as B


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows, num=17, den=20):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both, total = len(sets[i][1] & sets[j][1]), len(sets[i][1] | sets[j][1])
            if total and den * both >= num * total:
                root[max(top(i), top(j))] = min(top(i), top(j))
    low = {}
    for i, (k, s) in enumerate(sets):
        if k is not None:
            low[top(i)] = min(low.get(top(i), k), k)
    return sorted(((k, len(s), low.get(top(i)) if s else k) for i, (k, s) in enumerate(sets)), key=str)


def corpus(seed, words, families, clouds):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(words), rng.randrange(words))}"
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    for size, change in families:  # near copies of a model, which is there
        model = [word() for _ in range(rng.randrange(40, 120))]
        texts.append(" ".join(model))
        for _ in range(size):
            copy = list(model)
            for _ in range(rng.randrange(change + 1)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    for size in clouds:  # texts around a model that isn't there, few of them linked
        model = [word() for _ in range(80)]
        for _ in range(size):
            texts.append(" ".join(w if rng.random() > 0.03 else word() for w in model))
    lines = [" ".join(word() for _ in range(12)) for _ in range(6)]  # texts of common lines only
    texts += [" ".join(rng.sample(lines, rng.randrange(1, 6))) for _ in range(80)]
    texts += ["", " \n", "one", "One", "one two", "a b c", "A  b\tc", texts[5], texts[5].upper()]
    rows = [(k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (None, texts[7]), (None, None), (3, texts[9]), (900, None), rows[0]]


@pytest.mark.parametrize("seed,short,tile", [(1, 32, 256), (2, 2, 8), (3, 0, 5)])
def test_components_equal_all_pairs(spark, monkeypatch, seed, short, tile):
    monkeypatch.setattr(B, "SHORT", short)
    monkeypatch.setattr(B, "TILE", tile)
    rows = corpus(seed, 400, [(30, 4), (10, 8), (5, 1)], [40])
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).repartition(5)
    got = B.near_duplicates(df, bits=12 if seed == 2 else B.BUCKET_BITS).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_without_rounds_every_link_comes_from_the_lists(spark, monkeypatch):
    monkeypatch.setattr(B, "ROUNDS", 1)
    monkeypatch.setattr(B, "_heads", lambda labelled: B_heads(labelled).withColumn("hub", F.lit(0).cast("long")))
    monkeypatch.setattr(B, "SHORT", 6)
    monkeypatch.setattr(B, "TILE", 16)
    rows = corpus(4, 300, [(25, 5)], [30])
    got = B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


B_heads = B._heads


def test_the_union_sketch_bounds_the_overlap():
    rng = np.random.default_rng(5)
    levels = np.zeros(1 << 10, np.uint8)
    levels[::3] = 9
    for _ in range(300):
        pool = rng.integers(1, 1 << 62, 60).astype(np.uint64) << np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 60), replace=False)) for _ in range(2))
        x, y = (B.sketch(s, levels, 10) for s in (a, b))
        both, union, most = B.union_sketch(x, y, len(a), len(b))
        overlap = len(np.intersect1d(a, b))
        assert most >= overlap and both <= overlap and union >= both
        if 20 * overlap >= 17 * (len(a) + len(b) - overlap):
            assert both > 0  # a link is in one list at least


def test_words_of_powers_dont_meet(spark):
    """Regular words, for which a polynomial modulo a power of two is blind."""
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    rows = [(1, thue), (2, thue.translate(str.maketrans("ab", "ba"))), (3, f"x {thue} y"), (4, "x " + rows_swap(thue) + " y")]
    got = {r.doc_id: r.component_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def rows_swap(t):
    return t.translate(str.maketrans("ab", "ba"))

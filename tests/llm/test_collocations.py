"""Collocations against counting every phrase in a plain dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import collocations as C
from folioscope.llm.tables import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] = f.get((lang, tuple(w[i : i + m])), 0) + 1
    out = []
    for lang in sorted(n):
        own = {p: c for (x, p), c in f.items() if x == lang and c >= least and len(p) > 1}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in own.items():
            if any(len(q) > len(p) and c >= a and inside(p, q) for q, c in own.items()):
                continue
            cuts = []
            for k in range(1, len(p)):
                left, right = f[lang, p[:k]], f[lang, p[k:]]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def corpus(seed):
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(12)] + ["New", "York", "é", "\x01", "a\x02"]
    phrases = ["new york city", "Once upon a time there", "of the", "so far so good", "x y"]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(phrases) if rng.random() < 0.3 else rng.choice(common))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "! ", "\r\n", "."]))
        rows.append((rng.choice(["en", "en", "fr", None]), "".join(parts)))
    return [*rows, ("en", None), (None, None), ("xx", ""), ("xx", "?! \n"), ("und", "of the of the"), ("one", "word " * 50), rows[0], rows[0]]


@pytest.mark.parametrize("seed,least,partitions", [(1, 5, 3), (2, 12, 7)])
def test_equal_to_counting_everything(spark, seed, least, partitions):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).repartition(partitions)
    got = sorted(tuple(r) for r in C.collocations(df, least=least).collect())
    assert got == brute(rows, least) and len(got) > 20
    assert sorted(tuple(r) for r in C.collocations(df, least=least, top=3).collect()) == brute(rows, least, 3)
    assert C.collocations(df.limit(0), least=least).collect() == []


def test_small_sieves_and_blocks_change_nothing(spark, monkeypatch):
    """A sieve that is full and passes everything, and counts that are dealt early."""
    rows = corpus(3)
    everything = np.full(1 << (C.SIEVE_BITS - 3), 255, np.uint8)
    monkeypatch.setattr(C, "_sieve", lambda docs, *rest: docs.sparkSession.sparkContext.broadcast(everything))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert sorted(tuple(r) for r in C.collocations(df, least=6).collect()) == brute(rows, 6)


def test_scores_beyond_64_bits(spark):
    """a n over l r in whole numbers, where the products need more than 64 bits."""
    counts = [("en", 0, "", 9 * 10**12), ("en", 1, "a", 3_000_000_000_001), ("en", 1, "b", 2_999_999_999_999), ("en", 2, "a b", 2_999_999_999_999)]
    df = spark.createDataFrame(counts, "lang string, m int, phrase string, f long")
    import unittest.mock

    with unittest.mock.patch.object(C, "phrase_counts", lambda *a: df):
        got = C.collocations(df.select("lang", F.col("phrase").alias("text"))).collect()
    a, n, left, right = 2_999_999_999_999, 9 * 10**12, 3_000_000_000_001, 2_999_999_999_999
    assert [(r.phrase, r.score) for r in got] == [("a b", 1000 * a * n // (left * right))]


def test_streams_over_range_bounds(spark):
    """Counts of the parts, however few phrases a range holds."""
    rng = random.Random(8)
    phrases = {tuple(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(200)}
    phrases |= {p[:k] for p in phrases for k in range(1, len(p))}
    phrases |= {p[k:] for p in phrases for k in range(1, len(p))}
    f = {p: rng.randrange(100, 999) for p in phrases}
    rows = [("en", len(p), " ".join(p), c) for p, c in f.items()]
    df = spark.createDataFrame(rows, "lang string, m int, phrase string, f long")
    words = F.split("phrase", " ")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        for path, part in ((words, lambda p, k: p[:k]), (F.reverse(words), lambda p, k: p[len(p) - k :])):
            got = {tuple(r.phrase.split()): r.parts for r in C.stream(df, Scratch(spark), path, "t").collect()}
            assert got == {p: [f[part(p, k)] for k in range(1, len(p))] for p in phrases}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

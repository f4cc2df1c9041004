"""The models' cores against their definitions: segments, marginals, phrases, rolling hashes."""

import itertools
import random

import numpy as np

from folioscope.llm import fuzzy, language, quality, toxicity
from folioscope.llm import words as W


def maximal(scores, a, b):
    """All maximal segments: the best one, and those of what lies on either side of it."""
    best, at = 0.0, None
    for i in range(a, b):
        total = 0.0
        for j in range(i, b):
            total += scores[j]
            if total > best:
                best, at = total, (i, j)
    return [] if at is None else [*maximal(scores, a, at[0]), (*at, best), *maximal(scores, at[1] + 1, b)]


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.uniform(0.1, 3) if rng.random() < 0.4 else -rng.uniform(0.1, 2) for _ in range(rng.randrange(1, 40))]
        place = [k for k, s in enumerate(scores) if s > 0]
        gaps = [sum(scores[(place[i - 1] + 1 if i else 0) : k]) for i, k in enumerate(place)]
        got = [(place[a], place[b], s) for a, b, s in toxicity.segments([scores[k] for k in place], gaps)]
        want = maximal(scores, 0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_texts_without_a_segment_do_not_move_the_calibration(spark):
    rng = random.Random(6)
    plain, bad = [f"w{k}" for k in range(200)], [f"bad{k}" for k in range(12)]
    rows = []
    for k in range(600):
        toxic = k % 6 == 0
        words = rng.choices(plain, k=80)
        for _ in range(12 if toxic else int(k % 12 == 1)):
            words.insert(40, rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df, df)
    assert 1e-3 < model.lexicon.scale < 1e3 and 0 <= model.curve.none < 0.1
    got = toxicity.score(df, model).join(df.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)
    assert all(r.spans and r.spans[0].end > r.spans[0].start for r in got if r.toxic)


def test_marginals_of_every_labelling():
    rng = np.random.default_rng(4)
    for _ in range(20):
        counts = rng.integers(1, 7, int(rng.integers(1, 4)))
        n = int(counts.sum())
        x = quality.Lines(rng.normal(size=(n, 3)), np.ones(n), np.append(0, np.cumsum(counts)))
        weights, chain = rng.normal(size=3), rng.normal(size=(2, 2))
        good, pairs = quality.marginals(x, weights, chain)
        emit, want_pairs = x.features @ weights, np.zeros((2, 2))
        for a, b in itertools.pairwise(x.first):
            total, one, two = 0.0, np.zeros(b - a), np.zeros((2, 2))
            for y in itertools.product((0, 1), repeat=int(b - a)):
                p = np.exp(sum(emit[a + k] for k in range(b - a) if y[k]) + sum(chain[u, v] for u, v in itertools.pairwise(y)))
                total += p
                one += p * np.array(y)
                for u, v in itertools.pairwise(y):
                    two[u, v] += p
            assert np.allclose(good[a:b], one / total)
            want_pairs += two / total
        assert np.allclose(pairs, want_pairs)


def test_phrases_by_substring_search(monkeypatch):
    monkeypatch.setattr(language, "SEGMENT", 50)
    rng = random.Random(8)
    for _ in range(40):
        learned = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(1, 60))) for _ in range(3)]
        block = language.tabulated([language.learned(str(k), t) for k, t in enumerate(learned)])
        asked = [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(0, 130))) for _ in range(5)]
        got = language.phrases(block, asked)
        for t, row in zip(asked, got, strict=True):
            for text, n in zip(learned, row, strict=True):
                count, now = 0, b""
                for c in t:
                    c = bytes([c])
                    if now + c in text:
                        now += c
                    else:
                        count, now = count + 1, c if c in text else b""
                count += bool(t)
                assert n == count


def test_fingerprints_byte_by_byte():
    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    def roll(raw, k):
        h = sum((int(W.TABLE[raw[k - j]]) >> 32) * pow(0x01000193, j) for j in range(7) if k >= j) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        return h ^ h >> 13

    def pieces(raw, size):
        ends = [k + 1 for k in range(len(raw)) if roll(raw, k) % size == size - 1]
        if not ends or ends[-1] != len(raw):
            ends.append(len(raw))
        if len(ends) > 64:
            ends = [*ends[:63], len(raw)]
        out, start = "", 0
        for end in ends:
            h = sum(int(W.TABLE[c]) * pow(0x9E3779B97F4A7C15, j, 2**64) for j, c in enumerate(raw[start:end])) + end - start
            out += fuzzy.LETTERS[mix(h % 2**64) >> 58]
            start = end
        return out

    rng = random.Random(9)
    for n in [1, 5, 100, 700, 3000]:
        raw = bytes(rng.randrange(256) for _ in range(n))
        size = 3
        while n // (size * 2) >= 32:
            size *= 2
        while size > 3 and sum(roll(raw, k) % size == size - 1 for k in range(n)) < 16:
            size //= 2
        assert fuzzy.fingerprint(raw) == f"{size}:{pieces(raw, size)}:{pieces(raw, 2 * size)}"

"""The join's count vectors and block stream against counters."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import ngram_join


def test_minima_bound_the_overlap():
    rng = np.random.default_rng(3)
    for _ in range(100):
        s = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 400)), dtype=np.uint64))
        t = np.unique(np.concatenate([s[: len(s) // 2], rng.integers(0, 1 << 64, int(rng.integers(1, 400)), dtype=np.uint64)]))
        v, w = (ngram_join.groups(ngram_join.count_vector(x)) for x in (s, t))
        assert (v[1] == (s >> np.uint64(64 - v[0])).astype(np.int64)).all()
        bits = min(v[0], w[0])
        exact = (Counter((v[1] >> (v[0] - bits)).tolist()) & Counter((w[1] >> (w[0] - bits)).tolist())).total()
        assert ngram_join.minima(v, w) == exact >= len(np.intersect1d(s, t))
        fine, coarse = (ngram_join._dense(v, g) for g in (256, 64))
        assert (ngram_join._fold(fine, 64) == coarse).all()
        assert np.minimum(coarse, ngram_join._dense(w, 64)).sum() >= exact


@pytest.mark.parametrize("held", [3, 1 << 16])
def test_shared_keys_over_batches(held, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD", held)
    rng = random.Random(4)
    for _ in range(100):
        rows = sorted((rng.randrange(12), rng.randrange(9)) for _ in range(rng.randrange(60)))
        cuts = [0, *sorted(rng.randrange(len(rows) + 1) for _ in range(3)), len(rows)]
        batches = [pa.table({"h": pa.array([h for h, _ in rows[a:b]], pa.int64()), "sid": pa.array([x for _, x in rows[a:b]], pa.int64())}) for a, b in zip(cuts, cuts[1:])]
        batches = [x.combine_chunks().to_batches()[0] if x.num_rows else pa.RecordBatch.from_pylist([], x.schema) for x in batches]
        got = [(r["h"], r["sid"]) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist()]
        sizes = Counter(h for h, _ in set(rows))
        assert sorted(got) == sorted(x for x in set(rows) if sizes[x[0]] > 1)


def test_tree_lists_every_similar_pair_once():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 64, int(rng.integers(3, 300)), dtype=np.uint64))
        for _ in range(int(rng.integers(1, 12))):
            keep = rng.random(len(base)) < rng.choice([1.0, 0.95, 0.8])
            sets.append(np.unique(np.append(base[keep], rng.integers(0, 1 << 64, int(rng.integers(0, 4)), dtype=np.uint64))))
    sets = [s for s in sets if len(s)]
    sizes, labels = np.array([len(s) for s in sets]), rng.integers(0, 5, len(sets))
    vectors = [ngram_join.groups(ngram_join.count_vector(s)) for s in sets]
    got = [tuple(sorted(p)) for p in ngram_join.CountVectorTree(sizes, vectors, labels).pairs()]
    assert len(got) == len(set(got)) and all(labels[a] != labels[b] for a, b in got)
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if labels[a] != labels[b] and 4 * both >= 3 * (sizes[a] + sizes[b] - both):
                want.add((a, b))
    assert len(want) > 50 and want <= set(got) and len(got) < 3 * len(want)
    assert list(ngram_join.CountVectorTree(sizes[:0], [], labels[:0]).pairs()) == []

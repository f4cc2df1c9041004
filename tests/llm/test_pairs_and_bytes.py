"""Joins, containment, repeats and fingerprints against brute force, with odd rows."""

import hashlib
import random
from collections import Counter

from folioscope.llm import decontaminate, fuzzy, ngram_join, repeats

SCHEMA = "doc_id long, text string, sid string, h string"


def words(text):
    out, now = [], b""
    for b in (text or "").encode():
        if b in b" \t\n\x0b\x0c\r":
            if now:
                out.append(now)
            now = b""
        else:
            now += bytes([b + 32 if 65 <= b <= 90 else b])
    return [*out, now] if now else out


def shingles(text):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def corpus():
    rng = random.Random(5)
    texts = [None, "", "  \n ", "One two", "one TWO", "a b c d e"]
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([20, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for k in range(rng.choice([0, 0, 1, 3])):
                copy[rng.randrange(len(copy))] = f"x{k}{rng.randrange(999)}"
            texts.append(" ".join(copy))
    return [(k, t, "s", "h") for k, t in enumerate(texts)]


def test_join_components(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {k: shingles(t) for k, t, *_ in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}


def test_join_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.similar_components(empty).collect() == []
    one = ngram_join.one_per_group(spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (2, None, "", "")], SCHEMA))
    assert sorted((r.doc_id, r.text) for r in one.collect()) == [(1, "a b"), (2, None)]


def test_containment(spark):
    rows = corpus()
    items = [(k, " ".join(w.decode() for w in words(t)[:25]), "z") for k, t, *_ in rows if k % 3 == 0]
    got = {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string")).collect()}
    want = set()
    for i, t, _ in items:
        q = shingles(t)
        for k, d, *_ in rows:
            both = len(q & shingles(d))
            if q and 4 * both >= 3 * len(q):
                want.add((k, i, len(q), both))
    assert got == want
    kept = decontaminate.decontaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string, doc_id string"))
    assert {r.doc_id for r in kept.collect()} == {k for k, *_ in rows} - {k for k, *_ in want}


def test_repeated_bytes(spark):
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = part(70)
    texts = [None, "", "short", part(200) + shared + part(90), shared + part(150), part(100) + shared[:55] + part(20), "z" * 120, part(300)]
    texts += [texts[-1], part(60) * 2]
    rows = [(k, t, "", "") for k, t in enumerate(texts)] + [(3, texts[3], "", "")]
    n = 40
    raw = [(k, (t or "").encode()) for k, t, *_ in rows]
    seen = Counter(b[i : i + n] for _, b in raw for i in range(len(b) - n + 1))
    want = []
    for k, b in raw:
        gone = {j for i in range(len(b) - n + 1) if seen[b[i : i + n]] > 1 for j in range(i, i + n)}
        kept = bytes(x for j, x in enumerate(b) if j not in gone)
        want.append((k, len(b), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(kept).hexdigest()))
    got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), length=n)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    assert repeats.without_repeats(spark.createDataFrame([], SCHEMA), length=n).collect() == []


def test_repeated_bytes_when_a_join_turns_broadcast(spark):
    """Rows of one anchor meet in one task even if the join before the merge gives up its shuffle."""
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [part(60) for _ in range(80)]
    rows = [(k, part(rng.randrange(50, 90)) + shared[k % 80 if k < 240 else 0] + part(rng.randrange(50, 90)), "", "") for k in range(250)]
    n = 40
    seen = Counter(t[i : i + n] for _, t, *_ in rows for i in range(len(t) - n + 1))
    want = [(k, len({j for i in range(len(t) - n + 1) if seen[t[i : i + n]] > 1 for j in range(i, i + n)})) for k, t, *_ in rows]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "1000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        got = repeats.without_repeats(spark.createDataFrame(rows, SCHEMA), length=n, group=8).select("doc_id", "n_removed").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(map(tuple, got)) == want


def test_fingerprints(spark):
    rows = corpus()
    got = fuzzy.fingerprints(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    for (k, t, *_), (_, after, *_), r in zip(rows, rows[1:] + rows[:1], got, strict=True):
        new = fuzzy.edited(t or "", after or "")
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (k, len(t or ""), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fuzzy.fingerprint(t) and r.edited_fingerprint == fuzzy.fingerprint(new)
        assert r.near_next == fuzzy.likeness(fuzzy.fingerprint(t), fuzzy.fingerprint(after)) and 0 <= r.near_edited <= 1


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(65))) for _ in range(2))
        assert fuzzy.edit_distance(a, b) == plain(a, b)

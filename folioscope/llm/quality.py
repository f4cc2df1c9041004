"""Document quality by a linear-chain conditional random field over lines.

A line is good (1) or bad (0). Its features are shares of letters, capitals, digits,
symbols and the like, word statistics and repetition within the document, each also of
the line before and the line after; the chain adds a score for every pair of neighbouring
labels. Training marks every line of a labelled document with the document's label and
maximises the conditional likelihood. Scoring runs forward-backward over the whole
document; the marginals of "good", weighted by line length, average to the document's
mean, and a logistic curve fitted on the training documents turns its log-odds into a
probability of label 1.

Training uses at most ``SAMPLE`` labelled documents (those of the smallest hash of their
id), and of these, in the same order, whole ones of at most ``SAMPLE_LINES`` lines in all: a
bounded sample, so the driver holds about 80 MB of line features. Everything else covers all rows.

A null or empty text is one empty line; a very long one is scored whole, line by line. Without labels of both kinds every score is 0.5.
Rows that repeat are scored alike; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SAMPLE, SAMPLE_LINES = 4000, 200_000
THRESHOLD = 0.3
EPOCHS = 150
_B = np.arange(256)
_CLASSES = [
    (_B >= 65) & (_B <= 90),  # capitals
    (_B >= 97) & (_B <= 122) | (_B >= 128),  # small letters and bytes of other letters
    (_B >= 48) & (_B <= 57),  # digits
    np.isin(_B, np.frombuffer(b".,;:'\"()-?", np.uint8)),  # common marks
    np.isin(_B, np.frombuffer(b"!", np.uint8)),
    np.isin(_B, np.frombuffer(b"#$%&*+=@^~\\<>[]{}_`", np.uint8)),  # symbols
    np.isin(_B, np.frombuffer(b"|/", np.uint8)),
    W.SPACE,
]
FEATURES = len(_CLASSES) + 8


@dataclass
class Lines:
    features: np.ndarray  # a row per line
    weight: np.ndarray  # bytes + 1
    first: np.ndarray  # first line of each document, and the end


def lines(data: np.ndarray, at: np.ndarray) -> Lines:
    """Every document has at least one line; a line break ends a line."""
    breaks = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(at, breaks, "right") - 1
    start = np.concatenate([at[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(at) - 1), doc_of])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(at)))
    end = np.append(start[1:], 0)
    end[first[1:] - 1] = at[1:]
    inner = np.ones(len(start), bool)
    inner[first[1:] - 1] = False
    end[inner] -= 1
    size = end - start
    cols = []
    for c in _CLASSES:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(c[data], out=sums[1:])
        cols.append((sums[end] - sums[start]) / np.maximum(size, 1))
    w = W.words(data, at)
    line_of = np.searchsorted(start, w.start, "right") - 1
    n = np.bincount(line_of, minlength=len(start)).astype(float)
    length = np.bincount(line_of, weights=(w.end - w.start), minlength=len(start)) / np.maximum(n, 1)
    # words and lines that came before in the same document
    pairs = W.mix64(w.hash + w.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at_first = np.unique(pairs, return_index=True)
    seen = np.ones(len(pairs))
    seen[at_first] = 0
    again = np.bincount(line_of, weights=seen, minlength=len(start)) / np.maximum(n, 1)
    total_words = np.diff(w.first)
    doc_again = np.bincount(w.doc, weights=seen, minlength=len(at) - 1) / np.maximum(total_words, 1)
    with np.errstate(over="ignore"):
        mark = np.zeros(len(start), np.uint64)
        np.add.at(mark, line_of, W.mix64(w.hash + (w.start - start[line_of]).astype(np.uint64)))
        mark = W.mix64(mark + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at_first = np.unique(mark, return_index=True)
    repeat = np.ones(len(start))
    repeat[at_first] = 0
    closed = np.zeros(len(start))
    some = size > 0
    closed[some] = np.isin(data[end[some] - 1], np.frombuffer(b".!?", np.uint8)) if len(data) else 0
    cols += [np.log1p(n), length / 10, again, doc_again[doc], repeat, closed, np.log1p(np.diff(first))[doc] / 4, np.ones(len(start))]
    x = np.stack(cols, 1)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return Lines(np.hstack([x, before, after]), size + 1.0, first)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the feature row, for good against bad
    chain: np.ndarray  # 2 x 2
    mean: np.ndarray
    spread: np.ndarray
    a: float
    b: float


def marginals(x: Lines, weights: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line, and the expected counts of label pairs, over all documents at
    once: step t handles the t-th line of every document that has one."""
    emit = x.features @ weights
    count = np.diff(x.first)
    by_len = np.argsort(-count, kind="stable")
    first, count = x.first[:-1][by_len], count[by_len]
    steps = int(count.max(initial=0))
    having = np.searchsorted(-count, -np.arange(1, steps + 1), "right")  # documents with t lines or more
    fore, back = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    for t in range(steps):
        at = first[: having[t]] + t
        if t:
            p = fore[at - 1]
            fore[at] = np.logaddexp(p[:, :1] + chain[0], p[:, 1:] + chain[1])
        fore[at, 1] += emit[at]
        fore[at] -= np.logaddexp(fore[at, 0], fore[at, 1])[:, None]
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = first[: having[t + 1]] + t
        q = back[at + 1].copy()
        q[:, 1] += emit[at + 1]
        joint = fore[at][:, :, None] + chain[None] + q[:, None, :]
        top = joint.max((1, 2), keepdims=True)
        joint = np.exp(joint - top)
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back[at] = np.logaddexp(chain[:, 0] + q[:, :1], chain[:, 1] + q[:, 1:])
        back[at] -= np.logaddexp(back[at, 0], back[at, 1])[:, None]
    both = fore + back
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), pairs


def _means(x: Lines, good: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(x.first) - 1), np.diff(x.first))
    n = len(x.first) - 1
    return np.bincount(doc, weights=x.weight * good, minlength=n) / np.bincount(doc, weights=x.weight, minlength=n)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(x: Lines, label: np.ndarray) -> Model:
    """Adam on the penalised conditional log-likelihood; then the document curve."""
    gold = np.repeat(label, np.diff(x.first)).astype(float)
    mean, spread = x.features.mean(0), x.features.std(0) + 1e-6
    ones = x.features.std(0) < 1e-9
    mean[ones], spread[ones] = 0, 1
    z = Lines((x.features - mean) / spread, x.weight, x.first)
    inner = np.ones(len(gold), bool)
    inner[x.first[:-1]] = False
    k = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[k - 1].astype(int), gold[k].astype(int)), 1)
    w, chain = np.zeros(z.features.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(chain)]
    v = [np.zeros_like(w), np.zeros_like(chain)]
    for step in range(1, EPOCHS + 1):
        good, pairs = marginals(z, w, chain)
        grads = [z.features.T @ (gold - good) / len(gold) - 1e-4 * w, (seen - pairs) / len(gold) - 1e-4 * chain]
        for p, g, mm, vv in zip((w, chain), grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            p += 0.08 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
    s = _odds(_means(z, marginals(z, w, chain)[0]))
    a, b = 0.0, 1.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a + b * s, -30, 30)))
        q = p * (1 - p)
        h = np.array([[q.sum(), (q * s).sum()], [(q * s).sum(), (q * s * s).sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, [(p - label).sum(), ((p - label) * s).sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return Model(w, chain, mean, spread, a, max(b, 0.0))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = W.column(batch, "text")
        for a, b in W.slices(texts):
            x = lines(*W.flat(texts.slice(a, b - a)))
            rows = [np.hstack([x.weight[p:q, None], x.features[p:q]]).astype(np.float32).tobytes() for p, q in zip(x.first[:-1], x.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([W.column(batch, "key").slice(a, b - a), W.column(batch, "label").slice(a, b - a), pa.array(rows, pa.binary())], ["key", "label", "rows"])


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model | None:
    """Train on at most ``sample`` labelled documents and ``sample_lines`` lines; None without both labels."""
    named = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND key IS NOT NULL")
    chosen = F.broadcast(named.orderBy(F.xxhash64("key"), "key", "label").limit(sample).withColumn("h", F.xxhash64("key")))  # at most ``sample`` rows
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    sizes = d.join(chosen, "key").groupBy("key", "label", "h").agg(F.sum(size).alias("lines")).collect()  # no more rows than ``chosen``
    left, within = sample_lines, []
    for r in sorted(sizes, key=lambda r: (r.h, r.key, r.label)):
        if r.lines <= left:
            within.append((r.key, r.label))
            left -= r.lines
    chosen = F.broadcast(docs.sparkSession.createDataFrame(within, "key long, label int"))
    got = sorted(d.join(chosen, "key").select("key", "label", "text").mapInArrow(_features, "key long, label int, rows binary").toLocalIterator(), key=lambda r: (r.key, r.label, bytes(r.rows)))
    if len({r.label for r in got}) < 2:
        return None
    each = [np.frombuffer(r.rows, np.float32).reshape(-1, 3 * FEATURES + 1).astype(float) for r in got]
    every = np.vstack(each)
    x = Lines(every[:, 1:], every[:, 0], np.append(0, np.cumsum([len(e) for e in each])))
    return train(x, np.array([r.label for r in got], float))


def _score(model, detail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            texts, out, good_lines = W.column(batch, "text"), np.full(batch.num_rows, 0.5), []
            for a, b in W.slices(texts):
                x = lines(*W.flat(texts.slice(a, b - a)))
                if m is not None:
                    good, _ = marginals(Lines((x.features - m.mean) / m.spread, x.weight, x.first), m.weights, m.chain)
                    out[a:b] = 1 / (1 + np.exp(-(m.a + m.b * _odds(_means(x, good)))))
                else:
                    good = np.full(len(x.weight), 0.5)
                if detail:
                    good_lines += [good[p:q].tolist() for p, q in zip(x.first[:-1], x.first[1:], strict=True)]
            cols, names = [W.column(batch, "key"), pa.array(out)], ["key", "score"]
            if detail:
                cols, names = [*cols, pa.array(good_lines, pa.list_(pa.float64()))], [*names, "line_good"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", detail: bool = True) -> DataFrame:
    """(key, score, line_good, predicted): line_good has P(good) of every line in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = d.mapInArrow(_score(shared, detail), "key long, score double" + (", line_good array<double>" if detail else ""))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).withColumnRenamed("key", key)

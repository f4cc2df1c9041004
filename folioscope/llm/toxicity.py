"""Toxicity by maximum-scoring segments over token log-odds.

Tokens fall into 2^``BITS`` classes by hash, a fixed number whatever the vocabulary. Every class gets the log-odds of its
use in toxic and other labelled texts (documents that hold it, so that one long text
doesn't decide) under a Dirichlet prior of ``PRIOR`` documents a class, split like the labels, which keeps rare
tokens near zero. Every token, seen or not, scores its class' log-odds, of either sign and any size, and ``DRIFT``, which makes
neutral text negative; scores are whole 1/``UNIT`` so that sums are exact. The linear
scan of Ruzzo and Tompa lists every maximal segment of positive score. Segment scores are
calibrated by the extreme-value law of such scores: with lambda from the score
distribution of the non-toxic texts and K from their best segments, a segment of score S
in a text of n tokens has an expected number of E = K n exp(-lambda S); segments of
E < ``significance`` are reported. A document's statistic is the sum of -ln E over its
significant segments, or else that of its best; a logistic curve fitted to counts by
statistic and label turns it into a score between 0 and 1.

Counts and calibration use every labelled text that may be learned from; labels are joined
by one shuffle plan at every size, behind a sieve of 2 MB that keeps most other texts out of it. The scores
are a table of 4 MB in every worker.

A null or empty text has no token and gets the score of a text without a segment. Null
labels and labels without a document are not learned from; several labels of one id each
count. Rows that repeat are scored alike. Extra columns are ignored; without labels every
score is ``UNKNOWN``; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import written

BITS = 21
PRIOR = 20.0
DRIFT = -1.0
UNIT = 512  # 16 bits hold log-odds up to 64, more than any 64-bit counts give
SIGNIFICANCE = 0.05
UNKNOWN = 0.0
SIEVE = 1 << 24
THRESHOLD = 0.3
#: Everything in ASCII but letters and digits parts tokens.
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SPANS = "array<struct<start: long, end: long, score: double, expected: double>>"


def tokens(data: np.ndarray, at: np.ndarray) -> W.Words:
    spaced = np.where(PARTS[data], np.uint8(32), data)
    return W.words(spaced, at)


def classes(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def segments(scores: list[float], gaps: list[float]) -> list[tuple[int, int, float]]:
    """Ruzzo and Tompa's maximal segments. ``scores`` are the positive tokens' scores and
    ``gaps[k]`` the (negative) score of what lies before token k. (first, last, score)."""
    found: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total = 0.0
    for k, (score, gap) in enumerate(zip(scores, gaps, strict=True)):
        total += gap
        first, left, right = k, total, total + score
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= right:
                found.append((first, k, left, right))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r in found]


@dataclass(frozen=True)
class Lexicon:
    scores: np.ndarray  # of every class, in 1/UNIT; empty if nothing was learned
    rate: float  # lambda
    scale: float  # K


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = W.column(batch, "text"), W.column(batch, "label").to_numpy()
        for a, b in W.slices(texts):
            w = tokens(*W.flat(texts.slice(a, b - a)))
            held = np.unique((w.doc << BITS) + classes(w.hash))  # once a document
            each, inverse = np.unique(held & ((1 << BITS) - 1), return_inverse=True)
            ones = np.bincount(inverse, weights=labels[a:b][held >> BITS], minlength=len(each)).astype(np.int64)
            total = np.bincount(inverse, minlength=len(each))
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(ones), pa.array(total - ones)], ["class", "ones", "zeros"])


def _solve(chance: np.ndarray, scores: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1."""

    def f(x: float) -> float:
        with np.errstate(over="ignore"):
            return float((chance * np.exp(x * scores)).sum()) - 1

    if f(1e-6) >= 0:
        return 0.05  # the drift is not negative enough on average
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def lexicon(labelled: DataFrame, text: str = "text", label: str = "label") -> Lexicon:
    """Learn from (text, label 0/1) rows."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("double").alias("label")).where("label IN (0, 1)")
    counts = written(rows.mapInArrow(_counts, "class long, ones long, zeros long").groupBy("class").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")))
    all1, all0 = (float(x or 0) for x in counts.agg(F.sum("ones"), F.sum("zeros")).first())
    if not all1 or not all0:
        return Lexicon(np.zeros(0, np.int16), 1.0, 1.0)
    odds = lambda c, share: F.log(F.col(c) / share + PRIOR)
    delta = odds("ones", all1 / (all1 + all0)) - odds("zeros", all0 / (all1 + all0))
    known = counts.select("class", F.round((delta + DRIFT) * UNIT).cast("int").alias("score"), "zeros").toArrow()  # a row a class at most
    scores = np.full(1 << BITS, round(DRIFT * UNIT), np.int16)
    scores[known["class"].to_numpy()] = known["score"].to_numpy()
    value, at = np.unique(known["score"].to_numpy(), return_inverse=True)
    chance = np.bincount(at, weights=known["zeros"].to_numpy()) / all0
    return Lexicon(scores, _solve(chance, value / UNIT), 1.0)


def _statistics(m: Lexicon, texts: pa.Array, spans: bool) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Of every text: the statistic (NaN without a segment), tokens, significant passages."""
    n, least = len(texts), math.log(SIGNIFICANCE)
    stat, length, out = np.full(n, np.nan), np.zeros(n, np.int64), [[] for _ in range(n if spans else 0)]
    for a, b in W.slices(texts):
        data, at = W.flat(texts.slice(a, b - a))
        w = tokens(data, at)
        length[a:b] = np.diff(w.first)
        if not len(m.scores):
            continue
        value = m.scores[classes(w.hash)].astype(np.int64)
        sums = np.append(0, np.cumsum(value))
        hit = np.flatnonzero(value > 0)
        docs = w.doc[hit]
        cuts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else []
        for x, y in zip(cuts, [*cuts[1:], len(docs)], strict=False):
            d = int(docs[x])
            place = hit[x:y]
            gaps = sums[place] - np.append(sums[w.first[d]], sums[place[:-1] + 1])
            found = [(p, q, s / UNIT) for p, q, s in segments(value[place].tolist(), gaps.tolist())]
            logs = [math.log(m.scale * length[a + d]) - m.rate * s for _, _, s in found]  # ln E
            strong = [v for v in logs if v < least]
            stat[a + d] = -sum(strong) if strong else -min(logs)
            if spans:
                out[a + d] = [
                    {"start": int(w.start[place[p]] - at[d]), "end": int(w.end[place[q]] - at[d]), "score": s, "expected": math.exp(v)}
                    for (p, q, s), v in zip(found, logs, strict=True)
                    if v < least
                ]
    return stat, length, out


def _scan(lex, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stat, length, out = _statistics(lex.value, W.column(batch, "text"), spans)
            cols = [W.column(batch, "key"), pa.array(stat, from_pandas=True), pa.array(length)]
            names = ["key", "stat", "n_tokens"]
            if spans:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
                cols, names = [*cols, pa.array(out, kind)], [*names, "spans"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def scan(docs: DataFrame, lex: Lexicon, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(key, stat, n_tokens, spans): the statistic is null without a segment; spans are the
    significant passages, in bytes of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_scan(shared, spans), "key long, stat double, n_tokens long" + (f", spans {SPANS}" if spans else ""))


@dataclass(frozen=True)
class Curve:
    """P(label 1) = sigmoid(a + b stat), and the share of 1 among texts without a segment."""

    a: float
    b: float
    none: float


def fit_curve(counts: list[tuple[float | None, int, int]]) -> Curve:
    """counts: (statistic of the bin, labels 0, labels 1)."""
    n0 = sum(c for s, c, _ in counts if s is None)
    n1 = sum(c for s, _, c in counts if s is None)
    none = (n1 + 0.5) / (n0 + n1 + 2) if n0 + n1 else UNKNOWN
    x = np.array([s for s, _, _ in counts if s is not None], float)
    zero, one = (np.array([c[k] for c in counts if c[0] is not None], float) for k in (1, 2))
    if not len(x) or not one.sum():
        return Curve(0.0, 0.0, none)
    a, b = 0.0, 0.1
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = (zero + one) * p - one
        w = (zero + one) * p * (1 - p)
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, [g.sum() + 1e-2 * a, (g * x).sum() + 1e-2 * b])
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -1, 1))
    return Curve(a, max(b, 0.0), none)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    curve: Curve


def sieved(docs: DataFrame, named: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) of the documents whose id may be labelled: one bit of a bitmap for a hash of
    every labelled id. The bitmap has ``SIEVE`` bits, 2 MB, whatever the number of labels; a full
    one lets every document pass, and the join that follows decides."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    bits = named.select(slot(F.col("key")).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    d = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    at = F.bitmap_bit_position(slot(F.col(key)))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = d.join(F.broadcast(bits), F.bitmap_bucket_number(slot(F.col(key))) == F.col("bucket"))  # at most SIEVE / 32,768 rows of 4 KB
    return found.where(byte.bitwiseAND(F.pow(F.lit(2.0), at % 8).cast("int")) != 0).select(key, text)


def labelled(docs: DataFrame, named: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label), by a merge join whatever the number of labels."""
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).join(named.hint("merge"), "key")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Lexicon and calibration from the labelled texts given."""
    named = labels.select(F.col(key).cast("long").alias("key"), F.col(label).alias("label")).where("label IN (0, 1) AND key IS NOT NULL")
    named = written(named)
    docs = sieved(docs, named, key, text)
    first = lexicon(labelled(docs, named, key, text))
    raw = written(scan(docs, first, key, text, spans=False))
    bounded = F.when(F.col("stat").isNotNull(), F.round(F.least(F.greatest("stat", F.lit(-50.0)), F.lit(200.0)), 1))  # texts without a segment stay apart
    by = raw.join(named.hint("merge"), "key").groupBy(bounded.alias("bin"), "label").agg(F.count("*").alias("c"))
    rows = by.collect()  # bins of a bounded range
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.bin, [0, 0])[int(r.label)] += r.c
    # K: the median of the non-toxic texts' best segments should have E = ln 2
    zeros = sorted((b, c[0]) for b, c in bins.items() if b is not None and c[0])
    half, seen, shift = sum(c for _, c in zeros) / 2, 0, 0.0
    for b, c in zeros:
        seen += c
        if seen >= half:
            shift = b + math.log(math.log(2))
            break
    k = math.exp(min(max(shift, -20.0), 20.0)) if zeros else 1.0
    moved = [(None if b is None else b - math.log(k), *c) for b, c in bins.items()]
    lex = Lexicon(first.scores, first.rate, k)
    return Model(lex, fit_curve(moved))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(key, score, predicted, n_tokens, spans) for every row."""
    c = model.curve
    out = scan(docs, model.lexicon, key, text, spans)
    p = 1 / (1 + F.exp(-(F.lit(c.a) + F.lit(c.b) * F.col("stat"))))
    value = F.when(F.col("stat").isNull(), F.lit(c.none)).otherwise(F.greatest(p, F.lit(c.none)))
    out = out.withColumn("score", value).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop("stat")
    return out.withColumnRenamed("key", key)


def kept(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared, c = docs.sparkSession.sparkContext.broadcast(model.lexicon), model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stat, _, _ = _statistics(shared.value, W.column(batch, text), False)
            p = np.where(np.isnan(stat), c.none, np.maximum(1 / (1 + np.exp(-(c.a + c.b * np.nan_to_num(stat)))), c.none))
            yield batch.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

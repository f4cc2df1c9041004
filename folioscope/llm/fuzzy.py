"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last seven bytes cuts a text wherever it is -1 modulo the block
size; each piece gives one of 64 letters, by a hash of its bytes. The fingerprint is
``size:pieces:pieces at twice the size``. The size is 3 * 2**k, the largest for which
the text would have 32 pieces or more on average, halved until it has at least 16; at
most 64 letters are kept, the last of which stands for the rest of the text. Two
fingerprints are compared at a size they share: 1 - edit distance / longer length, and 0
if they share none; equal fingerprints are 1.

Null is the empty text, whose fingerprint is ``3::``. Very long texts are hashed whole, one at
a time. Equal texts have equal
fingerprints. Lone texts are their own next text. Rows of equal id are ordered by text;
null ids come first. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import written

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
MIN_SIZE, PIECES, KEPT, SPAN = 3, 32, 64, 7
_U32 = np.uint32
_ROLL = (W.TABLE >> np.uint64(32)).astype(_U32)


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes up to each byte (fewer at the start)."""
    b = _ROLL[data]
    h = b.copy()
    with np.errstate(over="ignore"):
        for k in range(1, SPAN):
            if len(data) > k:
                h[k:] += b[:-k] * _U32((0x01000193**k) & 0xFFFFFFFF)
        h ^= h >> _U32(15)
        h *= _U32(0x2C1B3C6D)
        h ^= h >> _U32(13)
    return h


def _pieces(cuts: np.ndarray, sums: np.ndarray, n: int) -> str:
    ends = np.append(cuts + 1, n) if not len(cuts) or cuts[-1] + 1 != n else cuts + 1
    if len(ends) > KEPT:
        ends = np.append(ends[: KEPT - 1], n)
    starts = np.append(0, ends[:-1])
    with np.errstate(over="ignore"):
        h = W.mix64((sums[ends] - sums[starts]) * W.powers(W._INV, n + 1)[starts] + (ends - starts).astype(np.uint64))
    return "".join(LETTERS[k] for k in (h >> np.uint64(58)).astype(np.int64))


def fingerprint(text: str | bytes | None) -> str:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    n = len(raw)
    if n == 0:
        return f"{MIN_SIZE}::"
    data = np.frombuffer(raw, np.uint8)
    size = MIN_SIZE
    while n // (size * 2) >= PIECES:
        size *= 2
    h = rolling(data)
    # a hash that is -1 modulo 3 * 2**k is -1 modulo every smaller size
    at = np.flatnonzero(h % _U32(MIN_SIZE) == MIN_SIZE - 1)
    h = h[at]
    while size > MIN_SIZE and np.count_nonzero(h % _U32(size) == size - 1) < PIECES // 2:
        size //= 2
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(W.TABLE[data] * W.powers(W._BASE, n), out=sums[1:])
    one, two = (at[h % _U32(s) == s - 1] for s in (size, 2 * size))
    return f"{size}:{_pieces(one, sums, n)}:{_pieces(two, sums, n)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a bit per letter of ``a`` (Myers' bit vectors)."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (every & ~(x | up)), up & x
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1 | 1) & every
        left = left << 1 & every
        y = eq | down
        up, down = left | (every & ~(y | right)), right & y
    return score


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (s, a1, a2), (t, b1, b2) = ((int(p), q, r) for p, q, r in (x.split(":") for x in (a, b)))
    if s == t:
        pairs = [(a1, b1), (a2, b2)]
    elif s == 2 * t:
        pairs = [(a1, b2)]
    elif t == 2 * s:
        pairs = [(a2, b1)]
    else:
        return 0.0
    return max(1 - edit_distance(x, y) / max(len(x), len(y)) if x and y else 0.0 for x, y in pairs)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(key, text: str, print_: str, following: str, next_print: str) -> tuple:
    new = edited(text, following)
    raw = new.encode("utf-8", "surrogatepass")
    new_print = fingerprint(raw)
    return key, len(text), hashlib.sha256(raw).hexdigest(), print_, new_print, likeness(print_, new_print), likeness(print_, next_print)


_NAMES = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_ENDS = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple], ends: list[tuple]) -> pa.RecordBatch:
    """Result rows, then rows that carry the text at one end of a partition, and its number."""
    part = TaskContext.get().partitionId()
    rows = [(*r, None, None, None) for r in rows] + [(k, None, None, p, None, None, None, end, t, part) for end, k, t, p in ends]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*_TYPES, pa.string(), pa.string(), pa.int64()], strict=True)], [*_NAMES, "edge", "text", "part"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: every document but the last with its successor; the first and
    the last go out with their text, to meet the neighbouring partitions."""
    held = None
    for batch in batches:
        rows, ends = [], []
        for key, text in zip(W.column(batch, "key").to_pylist(), W.column(batch, "text").to_pylist(), strict=True):
            now = (key, text or "", fingerprint(text))
            if held is None:
                ends.append(("first", *now))
            else:
                rows.append(_row(*held, now[1], now[2]))
            held = now
        yield _batch(rows, ends)
    if held is not None:
        yield _batch([], [("last", *held)])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_row(r["key"], r["text"], r["fingerprint"], r["next_text"], r["next_print"]) for r in batch.to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edit with the next text, and their likeness.

    Documents are range-partitioned by id once; within a partition each meets its
    successor as it streams by. Only two texts of every partition, its ends, are joined
    over partitions.
    """
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    walked = written(d.repartitionByRange(parts, "key").sortWithinPartitions("key", "text").mapInArrow(_walk, f"{_ENDS}, edge string, text string, part long"))
    inner = walked.where("edge IS NULL").select(*_NAMES)
    ends = walked.where("edge IS NOT NULL")
    firsts = ends.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    order = Window.orderBy("part")  # one number a partition, no texts
    after = firsts.select(F.col("next").alias("part")).withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(order)))
    lasts = ends.where("edge = 'last'").join(after, "part").join(firsts, "next")
    met = lasts.select("key", "text", "fingerprint", "next_text", "next_print").mapInArrow(_meet, _ENDS)
    return inner.unionByName(met).withColumnRenamed("key", key)

"""Words and shingles of whole texts, a block of documents at a time, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z are lower-cased.
Hashes are 64 bits wide, of the word's bytes (each byte's number times a number of its place,
summed and mixed; no powers of one base, for which regular words meet with certainty), so
equal words have equal hashes everywhere; two different shingles of one pair of documents
meet with a probability below 1e-10.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WIDTH = 5
BLOCK_BYTES = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


mix64 = _mix
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
TABLE = _mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER_TABLE = TABLE[LOWER]
_STEPS = _mix(np.arange(1, WIDTH + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
_powers: dict[int, np.ndarray] = {}
_places = np.zeros(0, dtype=_U)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=_U)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if len(have) <= 8 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def places(n: int) -> np.ndarray:
    """Odd numbers without a pattern for the places 0 .. n-1 of a word's bytes."""
    global _places
    if len(_places) >= n:
        return _places[:n]
    out = _mix(np.arange(1, max(n, 1 << 12) + 1, dtype=_U) * _U(0xE7037ED1A0B428DB)) | _U(1)
    if len(out) <= 8 * BLOCK_BYTES:
        _places = out
    return out[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets of each; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) else "") if texts.null_count else texts
    large = texts.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes of text, or of one row."""
    n = len(texts)
    if n == 0:
        return
    _, at = flat(texts)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


@dataclass
class Words:
    """Words of a block: start and end byte, document (row of the block) and hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # first word of each document; one more entry than documents


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> Words:
    n = len(data)
    inside = ~space[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(at, start, "right") - 1
    long = end - start
    hashed = np.zeros(len(start), dtype=_U)
    if len(start):
        first = np.cumsum(long) - long
        bytes_at = np.flatnonzero(inside)
        place = np.arange(len(bytes_at)) - np.repeat(first, long)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(LOWER_TABLE[data[bytes_at]] * places(int(long.max()))[place], first)
            hashed = _mix(sums + long.astype(_U))
    return Words(start, end, doc, hashed, np.searchsorted(doc, np.arange(len(at))))


def shingles(w: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``width`` words; a shorter text is one run."""
    counts = np.diff(w.first)
    with np.errstate(over="ignore"):
        m = len(w.hash) - width + 1
        if m > 0:
            out = np.zeros(m, dtype=_U)
            for k in range(width):
                out += w.hash[k : k + m] * _STEPS[k]
            keep = w.doc[:m] == w.doc[width - 1 :]
            runs, docs = _mix(out[keep]), w.doc[:m][keep]
        else:
            runs, docs = np.zeros(0, _U), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            one = np.array([_short(w.hash[w.first[d] : w.first[d + 1]]) for d in short], dtype=_U)
            docs = np.concatenate([docs, short])
            runs = np.concatenate([runs, one])
            order = np.argsort(docs, kind="stable")
            runs, docs = runs[order], docs[order]
    return runs, docs


def _short(hashes: np.ndarray) -> int:
    total = 0x2545F4914F6CDD1D * len(hashes)
    for k, h in enumerate(hashes):
        total += int(h) * int(_STEPS[k])
    return int(_mix(np.array([total & 0xFFFFFFFFFFFFFFFF], dtype=_U))[0])


def sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles of every text, blocks at a time."""
    for a, b in slices(texts):
        data, at = flat(texts.slice(a, b - a))
        runs, docs = shingles(words(data, at), width)
        bounds = np.searchsorted(docs, np.arange(b - a + 1))
        for k in range(b - a):
            yield a + k, np.unique(runs[bounds[k] : bounds[k + 1]])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)

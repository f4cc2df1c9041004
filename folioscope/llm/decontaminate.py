"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents may be long, so the measure is containment: the part
of an item's five-word shingles that a document holds. Items are partitioned by size; the
sketch of an item of m shingles is its k(m) smallest hashes (a bottom-k MinHash), with
k(m) = m - ceil(0.75 m) + 1, constant within a partition of equal m. A document that holds
0.75 of an item must hold one of these k, so the search loses nothing; candidates are
then verified on exact shingle sets. Documents smaller than 0.75 of a partition's m skip
it. Items go to the documents in blocks of ``BLOCK_SHINGLES`` shingles (16 MB, and the sketches),
each broadcast on its own, so a larger benchmark means more scans and not more memory: one
scan for about 20,000 items of 100 words. The driver holds one block at a time.

Null, empty and white-space texts match nothing; very long ones are searched whole; items without words are no items; items
shorter than five words are one shingle. Repeated rows are rows like others. Extra columns
are ignored. Empty tables on either side give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BLOCK_SHINGLES = 2_000_000
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, values = [], []
        for k, s in W.sets(W.column(batch, "text")):
            if len(s):
                rows.append(k)
                values.append(W.signed(s))
        ids = W.column(batch, "id").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(values, pa.list_(pa.int64()))], ["id", "s"])


class Sketches:
    """One block of items: sketch hash -> items, and their whole sets for the check."""

    def __init__(self, items: list[tuple[int, np.ndarray]], num: int, den: int) -> None:
        self.ids, self.sets, self.num, self.den = [i for i, _ in items], [s for _, s in items], num, den
        hashes, owners = [], []
        for m in sorted({len(s) for s in self.sets}):  # the partitions by size
            k = m - -(-num * m // den) + 1
            for j, s in enumerate(self.sets):
                if len(s) == m:
                    hashes.append(s[:k])
                    owners.append(np.full(k, j))
        h, o = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (hashes, owners))
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order].astype(np.int64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, runs: np.ndarray) -> np.ndarray:
        """Positions of ``runs`` that are in any sketch."""
        at = np.flatnonzero(self.sieve[(runs >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, runs[at]), len(self.hashes) - 1)
        return at[self.hashes[k] == runs[at]]

    def contained(self, runs: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, size, shared) of every item that the shingles hold enough of."""
        own = np.unique(runs)
        lo, hi = (np.searchsorted(self.hashes, runs[hit], side) for side in ("left", "right"))
        for j in sorted({int(o) for a, b in zip(lo, hi, strict=True) for o in self.owners[a:b]}):
            s = self.sets[j]
            if len(own) * self.den < len(s) * self.num:
                continue
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[at] == s).sum())
            if shared * self.den >= self.num * len(s):
                yield self.ids[j], len(s), shared


def _matches(block: Sketches, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, size, shared) of every match."""
    for a, b in W.slices(texts):
        data, at = W.flat(texts.slice(a, b - a))
        runs, docs = W.shingles(W.words(data, at))
        hit = block.hits(runs)
        for d in np.unique(docs[hit]):
            x, y = np.searchsorted(docs, [d, d + 1])
            own = hit[(hit >= x) & (hit < y)]
            for i, m, c in block.contained(runs[x:y], own - x):
                yield a + int(d), i, m, c


def _search(sketches):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = W.column(batch, "id").to_pylist()
            out = [(ids[k], i, m, c) for k, i, m, c in _matches(sketches.value, W.column(batch, "text"))]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item", "n_shared"])

    return run


def blocks(items: DataFrame, key: str, text: str, num: int, den: int) -> Iterator[Sketches]:
    """The items, in blocks of a bounded number of shingles."""
    named = items.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    block, held = [], 0
    for r in named.mapInArrow(_items, "id long, s array<long>").toLocalIterator():
        s = np.array(r.s, np.int64).view(np.uint64)
        if block and held + len(s) > BLOCK_SHINGLES:
            yield Sketches(block, num, den)
            block, held = [], 0
        block.append((r.id, s))
        held += len(s)
    if block:
        yield Sketches(block, num, den)


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", num: int = 3, den: int = 4
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared) for every document that holds num/den of an item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for block in blocks(items, item_key, item_text, num, den):
        out = out.unionByName(docs.mapInArrow(_search(spark.sparkContext.broadcast(block)), SCHEMA))
    return out


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", num: int = 3, den: int = 4) -> DataFrame:
    """The rows of ``docs`` that hold num/den of no item, with all their columns."""

    def without(sketches):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for k, *_ in _matches(sketches.value, W.column(batch, text)):
                    keep[k] = False
                yield batch.filter(pa.array(keep))

        return run

    for block in blocks(items, item_key, item_text, num, den):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs

"""Removal of long byte strings that occur more than once, within or across documents.

Repeats are found by merging Burrows-Wheeler transforms of shards, sampled at anchors. Every
window of ``length`` bytes belongs to its anchor: the place, among its first ``length - gram +
1``, whose next ``gram`` bytes have the smallest hash (the leftmost of them). The choice depends
on the window's bytes alone, so equal windows have anchors at equal places, and only suffixes
that begin at anchors need to be sorted. The windows of one anchor form a run, one row. Two
filters come first, and neither loses a repeat: an anchor whose gram is at one place only goes;
runs whose whole bytes are equal are one row, counted by partial sums. What is left are anchors
of which several different runs are known (where copies begin, end or differ).

Of these, each task (a shard) sorts its suffixes: its part of the transform is the order of the
right contexts, and the left contexts are its symbols. The shards' parts meet by anchor and are
merged by iterative interleave refinement. All suffixes of one gram begin as one interval; each
round looks at one more byte of those intervals that aren't settled, keeps the shards' order
within equal bytes and cuts the interval where the byte changes, and the round in which a cut
appears is the common prefix of the two neighbours. At most ``length - gram`` rounds are needed.
Then the intervals are followed to the left, a symbol a round: rows of an interval with equal
symbols stay together, and windows whose neighbour shares the bytes still missing on the right
are repeated. No suffix is sorted again, and no row is made for a byte. An anchor of more than
``group`` different runs would be a large interval in one task; its windows are counted by hash
instead, with partial sums.

Exact copies of a text of ``length`` bytes or more are removed whole. A null text is empty; a
text shorter than ``length`` is kept whole; a very long one is cut in one task, which holds its
bytes. Repeated rows are copies. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import Scratch

LENGTH = 400
GRAM = 200
GROUP = 1024
MERGED = 1 << 13  # rows that are merged at once, or one group
_PLACE_BITS = 32  # of a gram's 64 bits, the first 32 order the grams and the last 32 give way to its place
_U = np.uint64


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum(W.TABLE[data] * W.powers(W._BASE, len(data)), out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mix64((sums[end] - sums[start]) * W.powers(W._INV, len(sums))[start] + _U(1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    fore = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def runs(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, place of the anchor after the first window, anchor hash,
    hash of the run) of a block's runs; windows are counted from the document's start."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U, _U))
    n = len(data)
    if n < length:
        return none
    sums = _sums(data)
    grams = np.arange(n - gram + 1)
    h = _hash(sums, grams, grams + gram)
    keyed = (h >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | grams.astype(_U)
    anchor = (sliding_min(keyed, length - gram + 1) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    window = np.arange(n - length + 1)
    doc = np.searchsorted(at, window, "right") - 1
    inside = window + length <= at[doc + 1]
    window, doc, anchor = window[inside], doc[inside], anchor[inside]
    if not len(window):
        return none
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    lo, hi, doc, anchor = window[first], window[last], doc[first], anchor[first]
    with np.errstate(over="ignore"):
        whole = W.mix64(_hash(sums, lo, hi + length) + (anchor - lo).astype(_U) * _U(0x9E3779B97F4A7C15) + (hi - lo).astype(_U))
    return doc, lo - at[doc], hi - lo + 1, anchor - lo, h[anchor], whole


RUNS = "t1 long, t2 long, lo long, n long, at long, key long, whole long"


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            texts = W.column(batch, "text")
            ids = [W.column(batch, c).to_numpy() for c in ("t1", "t2")]
            for a, b in W.slices(texts):
                fresh = np.ones(b - a, bool)  # copies within a task give their runs once
                for k in range(b - a):
                    t = (ids[0][a + k], ids[1][a + k])
                    fresh[k] = t not in seen
                    seen.add(t)
                data, at = W.flat(texts.slice(a, b - a).filter(pa.array(fresh)))
                own = a + np.flatnonzero(fresh)
                doc, lo, n, place, key, whole = runs(data, at, length, gram)
                doc = own[doc] if len(doc) else doc
                cols = [ids[0][doc], ids[1][doc], lo, n, place, W.signed(key), W.signed(whole)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t1", "t2", "lo", "n", "at", "key", "whole"])

    return run


PART = "key long, shard int, rank long, whole long, at long, n long, full boolean, bytes binary"


def _shards(length: int, gram: int):
    """A task's part of the transform: the runs asked for, by gram and then by right context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rank = TaskContext.get().partitionId(), 0
        names = ["key", "shard", "rank", "whole", "at", "n", "full", "bytes"]
        for batch in batches:
            texts, rows = W.column(batch, "text"), []
            for k, asked in enumerate(W.column(batch, "asked").to_pylist()):
                raw = W.flat(texts.slice(k, 1))[0].tobytes() if asked else b""
                rows += [(r["key"], raw[r["lo"] + r["at"] + gram : r["lo"] + r["n"] - 1 + length], raw[r["lo"] : r["lo"] + r["n"] - 1 + length], r) for r in asked or []]
            rows.sort(key=lambda x: x[:2])
            cols = [[x[0] for x in rows], [shard] * len(rows), list(range(rank, rank + len(rows))), *[[x[3][c] for x in rows] for c in ("whole", "at", "n", "full")], [x[2] for x in rows]]
            rank += len(rows)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names)

    return run


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    """A row per string; beyond its end numbers that equal nothing of another row."""
    out = np.tile((256 + np.arange(len(parts), dtype=np.int32))[:, None], (1, width))
    for k, p in enumerate(parts):
        out[k, : len(p)] = np.frombuffer(p, np.uint8)
    return out


def interleaved(start: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal ``start`` (sorted) by their right contexts: the order, and for each row the
    bytes it shares with the one before (-1 at the first of an interval).

    A round refines the interleave by one byte, in intervals of two rows or more only.
    """
    n, width = right.shape
    order, common = np.arange(n), np.full(n, width)
    common[np.flatnonzero(np.append(True, start[1:] != start[:-1]))] = -1
    for k in range(width + 1):
        cut = common < width  # an interval begins here
        open_ = ~cut | np.append(~cut[1:], False)
        if k == width or not open_.any():
            break
        at = np.flatnonzero(open_)
        interval, byte = np.cumsum(cut)[at], right[order[at], k]
        move = np.lexsort((byte, interval))  # stable: equal bytes keep their order
        order[at], byte = order[at][move], byte[move]
        new = np.flatnonzero((interval[1:] == interval[:-1]) & (byte[1:] != byte[:-1])) + 1
        common[at[new]] = k
    return order, common


def repeated(start: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of rows of equal ``start``: [row, a] is whether another row shares the a bytes before and
    the width - a bytes after the gram. ``left`` runs away from the gram."""
    n, width = right.shape
    out = np.zeros((n, width + 1), bool)
    order, common = interleaved(start, right)
    for a in range(width + 1):
        near = np.maximum(common, np.append(common[1:], -1))
        out[order, a] = near >= width - a
        # rows whose neighbours share less than nothing are alone in their interval
        keep = near >= 0
        order, common = order[keep], common[keep]
        if a == width or not len(order):
            break
        interval, symbol = np.cumsum(common < 0), left[order, a]
        move = np.lexsort((symbol, interval))  # stable: the order on the right stays
        before, order = common, order[move]
        same = (interval[1:] == interval[:-1]) & (symbol[move][1:] == symbol[move][:-1])
        next_to = same & (move[1:] == move[:-1] + 1)
        common = np.full(len(order), -1)
        common[1:][next_to] = before[move[1:][next_to]]
        far = np.flatnonzero(same & ~next_to) + 1
        for x in range(0, len(far), 4096):
            rows = far[x : x + 4096]
            differ = right[order[rows - 1]] != right[order[rows]]
            common[rows] = np.where(differ.any(1), differ.argmax(1), width)
    return out


def _merged(length: int, gram: int):
    """Rows of all shards by key -> intervals of the repeated windows of every run."""
    width = length - gram

    def merge(rows: list[dict]) -> tuple[list, list, list]:
        grams = [(r["key"], r["bytes"][r["at"] : r["at"] + gram]) for r in rows]  # equal hashes may have different bytes
        numbers = {g: k for k, g in enumerate(dict.fromkeys(grams))}
        start = np.array([numbers[g] for g in grams])
        by = np.argsort(start, kind="stable")
        rows, start = [rows[k] for k in by], start[by]
        left = _padded([r["bytes"][: r["at"]][::-1] for r in rows], width)
        right = _padded([r["bytes"][r["at"] + gram :] for r in rows], width)
        again, keys, wholes, offs = repeated(start, left, right), [], [], []
        for k, r in enumerate(rows):
            if not r["full"]:
                found = again[k, r["at"] - r["n"] + 1 : r["at"] + 1][::-1].astype(np.int8)  # by window, from the first
                edges = np.flatnonzero(np.diff(found, prepend=0, append=0))
                if len(edges):
                    keys.append(r["key"])
                    wholes.append(r["whole"])
                    offs.append(edges.tolist())
        return keys, wholes, offs

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        keys, wholes, offs = merge(rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(wholes, pa.int64()), pa.array(offs, pa.list_(pa.int64()))], ["key", "whole", "offs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= MERGED and r["key"] != held[-1]["key"]:
                    yield batch_of(held)
                    held = []
                held.append(r)
        yield batch_of(held)

    return run


def _windows(length: int):
    """Hashes of every window of the runs asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data, off = np.frombuffer(r["bytes"], np.uint8), np.arange(r["n"])
                window = [np.frombuffer(hashlib.blake2b(data[k : k + length], digest_size=16).digest(), np.int64) for k in off]
                w = np.array(window).reshape(-1, 2)
                cols = [np.ascontiguousarray(w[:, 0]), np.ascontiguousarray(w[:, 1]), np.full(len(off), r["key"]), np.full(len(off), r["whole"]), np.full(len(off), r["full"]), off]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["w1", "w2", "key", "whole", "full", "off"])

    return run


def _counted(parts: DataFrame, length: int) -> DataFrame:
    """The same as ``_merged`` by counting windows, for anchors of very many different runs."""
    windows = parts.select("key", "whole", "n", "full", "bytes").mapInArrow(_windows(length), "w1 long, w2 long, key long, whole long, full boolean, off long")
    several = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2")
    again = windows.where("NOT full").join(several, ["w1", "w2"], "left_semi")
    offs = again.groupBy("key", "whole").agg(F.array_sort(F.collect_list("off")).alias("o"))  # at most a run's windows
    pair = lambda x: F.array(x, x + 1)
    return offs.select("key", "whole", F.flatten(F.transform("o", pair)).alias("offs"))


def covered(n_bytes: int, places: list[dict], length: int) -> tuple[np.ndarray, int]:
    """Which bytes the repeated windows cover, and the number of maximal runs."""
    change = np.zeros(n_bytes + 1, np.int64)
    for r in places:
        if r["offs"] is None:
            change[r["lo"]] += 1
            change[r["lo"] + r["n"] - 1 + length] -= 1
        else:
            offs = r["lo"] + np.array(r["offs"], np.int64)  # begin and end of each range of windows
            np.add.at(change, offs[::2], 1)
            np.add.at(change, offs[1::2] - 1 + length, -1)
    inside = np.cumsum(change)[:-1] > 0
    return inside, int(np.count_nonzero(np.diff(inside.astype(np.int8), prepend=0) == 1))


def _kept(length: int, detail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, places, texts = (W.column(batch, c) for c in ("t1", "t2", "places", "text"))
            removed, spans, sha, left = [], [], [], []
            for k, p in enumerate(places.to_pylist()):
                data, _ = W.flat(texts.slice(k, 1))
                inside, n = covered(len(data), p, length)
                kept = data[~inside].tobytes()
                removed.append(int(inside.sum()))
                spans.append(n)
                sha.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            cols, names = [t1, t2, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], ["t1", "t2", "n_removed", "n_spans", "kept_sha256"]
            if detail:
                cols, names = [*cols, pa.array(left, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int | None = None, detail: bool = True, group: int = GROUP
) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept): ``kept`` has the bytes left, or
    null where nothing was removed."""
    gram = gram or max(1, min(GRAM, length // 2))
    scratch = Scratch(docs.sparkSession)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    d = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    d = d.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    rows = scratch.put(d.select("key", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "rows")
    copies = scratch.put(rows.where(F.col("n_bytes") >= length).groupBy("t1", "t2").agg(F.count("*").alias("c"), F.min("key").alias("key")), "copies")
    every = scratch.put(d.where(F.octet_length("text") >= length).select("t1", "t2", "text").mapInArrow(_runs(length, gram), RUNS), "every")

    # anchors at one place only are most of all, and need no further look
    spot = F.xxhash64("t1", "t2", "lo")
    several = scratch.put(every.groupBy("key").agg(F.min(spot).alias("a"), F.max(spot).alias("z")).where("a != z").select("key"), "several")
    found = scratch.put(every.join(several, "key", "left_semi"), "found")
    scratch.drop(every, several)
    place = F.struct("t1", "t2", "lo", "n", "at")
    kinds = found.groupBy("key", "whole").agg(F.min(place).alias("a"), F.max(place).alias("z")).select("key", "whole", "a", (F.col("a") != F.col("z")).alias("full"))
    kinds = scratch.put(kinds, "kinds")
    differ = scratch.put(kinds.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "differ")
    compare = kinds.join(differ, "key").select("a.t1", "a.t2", "a.lo", "a.n", "a.at", "key", "whole", "full")
    full = kinds.where("full").select("key", "whole")

    # each text is fetched once, with what is asked of it
    single = copies.where("c = 1").select("t1", "t2")
    asked = compare.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "n", "at", "key", "whole", "full")).alias("asked"))  # of one text
    some = found.join(full, ["key", "whole"], "left_semi").select("t1", "t2").distinct()
    needed = copies.join(some.join(asked, ["t1", "t2"], "full"), ["t1", "t2"]).select(F.col("t1").alias("n1"), F.col("t2").alias("n2"), F.col("key").alias("nk"), "asked")
    texts = d.join(needed, (d.t1 == needed.n1) & (d.t2 == needed.n2) & d.key.eqNullSafe(needed.nk)).select("t1", "t2", "text", "asked")
    texts = scratch.put(texts.dropDuplicates(["t1", "t2"]), "texts")

    part = scratch.put(texts.where("asked IS NOT NULL").select("text", "asked").mapInArrow(_shards(length, gram), PART), "part")
    large = differ.where(F.col("c") > group).select("key")
    # by a hash of the key: dealt by the key itself, Spark takes the join's shuffle for this one, and
    # reads it locally, anchors torn apart, once it turns the join into a broadcast
    merged = part.join(large, "key", "left_anti").repartition(parts, F.xxhash64("key")).sortWithinPartitions("key", "shard", "rank").mapInArrow(_merged(length, gram), "key long, whole long, offs array<long>")
    counted = _counted(part.join(large, "key", "left_semi"), length)
    status = scratch.put(merged.unionByName(counted).unionByName(full.withColumn("offs", F.lit(None).cast("array<long>"))), "status")
    scratch.drop(part, kinds, differ)
    places = found.join(single, ["t1", "t2"], "left_semi").join(status, ["key", "whole"]).groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "n", "offs")).alias("places"))
    schema = "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if detail else "")
    cut = scratch.put(places.join(texts, ["t1", "t2"]).select("t1", "t2", "places", "text").mapInArrow(_kept(length, detail), schema), "cut")
    scratch.drop(found, status, texts)

    # texts that have copies and texts that were cut are different ones: one join for both, whose
    # crowded keys Spark can split
    marks = copies.where("c > 1").select("t1", "t2", F.lit(True).alias("twice")).unionByName(cut, allowMissingColumns=True)
    out = rows.join(marks, ["t1", "t2"], "left")
    is_twice = F.col("twice").isNotNull()
    empty = hashlib.sha256(b"").hexdigest()
    cols = [
        F.col("key").alias(key),
        "n_bytes",
        F.when(is_twice, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(is_twice, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(is_twice, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if detail:
        cols.append(F.when(is_twice, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*cols)

"""Collocations per language from ordered count streams, merged in lockstep.

Texts are lower-cased in A-Z and split at . , ; : ! ? and 0x0A-0x0D into pieces; words are what
lies between spaces and tabs. A phrase's count is the number of its contiguous occurrences
within pieces. Phrases of 2 to 5 words with a count of ``least`` or more are candidates; every
cut of one into a first part (count l) and a rest (count r) scores floor(1000 a n / (l r)) with
the language's number of words n, and the lowest counts.

Counting. A frequent phrase has only frequent parts, so the orders are counted one after the
other: a task reads its texts, keeps the phrases whose parts are frequent, sorts and counts their
hashes, and deals the sorted runs by ranges of the hash; a range's runs are merged one range at a
time. What is frequent goes into a sieve of 2**``SIEVE_BITS`` bits, a fixed size at any scale:
it is only used to leave phrases out that can't be frequent, a fuller sieve leaves fewer out. The
last pass counts the phrases themselves, by their words, so neither hashes nor the sieve decide
a result.

Scoring. The frequent phrases of a language, shorter ones included, are kept in two orders: by
words from the first (prefix order) and by words from the last (suffix order). In prefix order
the parts that a phrase begins with lie before it and are what a stack of counts holds while the
stream goes by, so one scan gives l of every cut, and the scan in suffix order gives r; nothing
is looked up by a hash. Both streams are dealt by ranges, and a range begins with the counts that
its first phrase's parts have in ranges before (at most four a range), so no word or language
has to be in one task. A merge join of the two scans has all cuts of a phrase, and its
one word shorter parts: one of the same count that lies inside it is dropped.

Null texts are empty; null languages are ``und``; repeated rows count as often as they occur;
ties are broken by the smallest cut and the phrase's bytes; an empty table gives an empty table.
Texts of any length are taken whole. Columns other than text and language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import Scratch

LEAST, TOP, ORDERS = 100, 2000, 5
SIEVE_BITS = 27  # 16 MB in a worker for each of the four sieves
PENDING = 1 << 21  # hashes that a task holds before it sorts and counts them
SLICES = 8  # ranges of the hash for each partition; one at a time is merged
TAIL = 5  # bytes of a hash below its range
_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = True
_APART = W.SPACE | _BREAK
_FIRST, _NEXT = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


def _seed(lang: str) -> int:
    """A number for a language, so that its phrases' hashes are its own."""
    raw = np.frombuffer(b"lang:" + lang.encode(), np.uint8)
    return int(W.words(raw, np.array([0, len(raw)]), np.zeros(256, bool)).hash[0])


class Sieve:
    """A bit for two places of every hash: what isn't in it, isn't frequent."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        again = W.mix64(v)
        return (again >> _U(64 - SIEVE_BITS)).astype(np.int64), (again & _U((1 << SIEVE_BITS) - 1)).astype(np.int64)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        one, two = self.places(v)
        keep = (self.bits[one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(keep)
        keep[at] = (self.bits[two[at] >> 3] >> (two[at] & 7).astype(np.uint8)) & 1 == 1
        return keep


def _phrases(w: W.Words, run: np.ndarray, seeds: np.ndarray, tests: list, orders: int, cut: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, first words, hashes) of the phrases of a block whose parts pass the sieves."""
    with np.errstate(over="ignore"):
        single = W.mix64(w.hash ^ seeds[w.doc])
        at, g = np.arange(len(single)), single
        for m in range(1, orders + 1):
            if m > 1:
                go = np.flatnonzero(at[1:] == at[:-1] + 1)
                if m == 2:
                    go = go[run[at[go]] == run[at[go] + 1]]
                g = W.mix64(g[go] * _FIRST + single[at[go] + m - 1] * _NEXT)
                at = at[go]
            if m <= len(tests):
                keep = tests[m - 1](g >> _U(cut))
                at, g = at[keep], g[keep]
            yield m, at, g


def _blocks(batch: pa.RecordBatch, known: dict[str, int]) -> Iterator[tuple]:
    """Bytes, words, pieces and language seeds of a batch's texts, a block at a time."""
    langs, texts = W.column(batch, "lang"), W.column(batch, "text")
    for a, b in W.slices(texts):
        data, at = W.flat(texts.slice(a, b - a))
        names = langs.slice(a, b - a).to_pylist()
        for x in set(names) - known.keys():
            known[x] = _seed(x)
        w = W.words(data, at, _APART)
        run = np.cumsum(_BREAK[data])[w.start] + w.doc
        yield data, w, run, names, np.array([known[x] for x in names], _U)


def _counted(sieves: list, first: int, last: int, slice_bits: int):
    """Sorted runs of the hashes of orders first..last with their counts, by ranges of the hash."""
    cut = 64 - slice_bits - 8 * TAIL

    def rows(parts: list[np.ndarray]) -> pa.RecordBatch:
        v, c = np.unique(np.concatenate(parts), return_counts=True)
        part = (v >> _U(8 * TAIL)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(v) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(v)) if len(v) else starts
        tails = v.view(np.uint8).reshape(-1, 8)[:, :TAIL]
        counts = c.astype(np.uint32)
        return pa.RecordBatch.from_arrays([
            pa.array(part[starts].astype(np.int32)), pa.array([tails[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary()),
            pa.array([counts[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary()),
        ], ["part", "tails", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, known, parts, held = [Sieve(s.value) for s in sieves], {}, [], 0
        for batch in batches:
            for _, w, pieces, _, seeds in _blocks(batch, known):
                for m, _, g in _phrases(w, pieces, seeds, tests, last, cut):
                    if m >= first:
                        parts.append(g >> _U(cut))
                        held += len(g)
                if held >= PENDING:
                    yield rows(parts)
                    parts, held = [], 0
        if held:
            yield rows(parts)

    return run


def _frequent(least: int):
    """Runs in order of their range -> the sieve's words (of 64 bits) with what is frequent."""

    def found(part: int, tails: list[bytes], counts: list[bytes]) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(tails), np.uint8).reshape(-1, TAIL)
        v = np.zeros((len(raw), 8), np.uint8)
        v[:, :TAIL] = raw
        v = v.view(_U).ravel()
        v, of = np.unique(v, return_inverse=True)
        total = np.bincount(of, weights=np.frombuffer(b"".join(counts), np.uint32), minlength=len(v))
        v = v[total >= least] | _U(part << (8 * TAIL))
        at = np.concatenate(Sieve.places(v))
        word, inside = at >> 6, np.left_shift(_U(1), (at & 63).astype(_U))
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(inside.view(np.int64))], ["word", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tails, counts = None, [], []
        for batch in batches:
            for part, t, c in zip(*(W.column(batch, x).to_pylist() for x in ("part", "tails", "counts")), strict=True):
                if at is not None and part != at:
                    yield found(at, tails, counts)
                    tails, counts = [], []
                at = part
                tails.append(t)
                counts.append(c)
        if at is not None:
            yield found(at, tails, counts)

    return run


def _sieve(docs: DataFrame, sieves: list, first: int, last: int, slice_bits: int, least: int):
    """The sieve of the phrases of orders first..last, broadcast: a table of a fixed size."""
    spark = docs.sparkSession
    runs = docs.mapInArrow(_counted(sieves, first, last, slice_bits), "part int, tails binary, counts binary")
    merged = runs.repartition(_parts(spark), "part").sortWithinPartitions("part").mapInArrow(_frequent(least), "word long, bits long")
    words = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for batch in merged.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        words[W.column(batch, "word").to_numpy()] = W.column(batch, "bits").to_numpy()
    return spark.sparkContext.broadcast(words.view(np.uint8))


def _named(sieves: list, slice_bits: int):
    """The phrases that pass all sieves with a task's counts, by ranges of the hash, a row for
    each range; m = 0 is the number of words."""
    cut, top = 64 - slice_bits - 8 * TAIL, _U(64 - slice_bits)

    def rows(held: dict) -> pa.RecordBatch:
        ranges: dict[int, list] = {}
        for (part, *key), f in held.items():
            ranges.setdefault(part, []).append((*key, f))
        lists = [[[x[k] for x in found] for found in ranges.values()] for k in range(4)]
        phrases = pa.array(lists[2], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(list(ranges), pa.int32()), pa.array(lists[0], pa.list_(pa.string())), pa.array(lists[1], pa.list_(pa.int32())), phrases, pa.array(lists[3], pa.list_(pa.int64()))], ["part", "lang", "m", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, known, held = [Sieve(s.value) for s in sieves], {}, {}
        for batch in batches:
            for data, w, pieces, names, seeds in _blocks(batch, known):
                raw, start, end = W.LOWER[data].tobytes(), w.start, w.end
                for x, seed, n in zip(names, (seeds >> top).tolist(), np.diff(w.first).tolist(), strict=True):
                    held[seed, x, 0, b""] = held.get((seed, x, 0, b""), 0) + n
                for m, at, g in _phrases(w, pieces, seeds, [*tests, tests[-1]], ORDERS, cut):
                    distinct, where, counts = np.unique(g, return_index=True, return_counts=True)
                    for part, i, c in zip((distinct >> top).tolist(), at[where].tolist(), counts.tolist(), strict=True):
                        key = part, names[w.doc[i]], m, b" ".join(raw[start[j] : end[j]] for j in range(i, i + m))
                        held[key] = held.get(key, 0) + c
                if len(held) > PENDING >> 2:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    return run


def _totals(least: int):
    """Rows in order of their range -> (lang, m, phrase, f) with f >= least, and those of m = 0."""

    def found(held: dict) -> pa.RecordBatch:
        keep = [(*key, f) for key, f in held.items() if f >= least or key[1] == 0]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in keep], t) for k, t in enumerate(kinds)], ["lang", "m", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            for part, *lists in zip(*(W.column(batch, x).to_pylist() for x in ("part", "lang", "m", "phrase", "f")), strict=True):
                if part != at:
                    yield found(held)
                    at, held = part, {}
                for *key, f in zip(*lists, strict=True):
                    held[tuple(key)] = held.get(tuple(key), 0) + f
        yield found(held)

    return run


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def phrase_counts(docs: DataFrame, scratch: Scratch, lang: str = "lang", text: str = "text", least: int = LEAST) -> DataFrame:
    """(lang, m, phrase, f) of all phrases of up to five words with f >= least; m = 0: of all words."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    slice_bits = min((_parts(docs.sparkSession) * SLICES - 1).bit_length(), 64 - 8 * TAIL)
    sieves: list = []
    for first, last in ((1, 1), (2, 2), (3, 3), (4, ORDERS)):
        sieves.append(_sieve(docs, sieves, first, last, slice_bits, least))
    named = docs.mapInArrow(_named(sieves, slice_bits), "part int, lang array<string>, m array<int>, phrase array<string>, f array<long>")
    dealt = named.repartition(_parts(docs.sparkSession), "part").sortWithinPartitions("part")
    return scratch.put(dealt.mapInArrow(_totals(least), "lang string, m int, phrase string, f long"), "counts")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases in order of their paths -> each with the counts of the parts its path begins with."""
    lang, stack = None, []  # the path so far: words and counts
    for batch in batches:
        out: list[tuple] = []
        columns = (W.column(batch, c).to_pylist() for c in ("lang", "path", "phrase", "f", "carried"))
        for of, path, phrase, f, carried in zip(*columns, strict=True):
            if of != lang:
                lang, stack = of, []
            k = 0
            while k < len(stack) and k < len(path) - 1 and stack[k][0] == path[k]:
                k += 1
            stack[k:] = [(path[-1], f)]
            assert k == len(path) - 1, "a part of a frequent phrase is missing"
            if not carried:
                out.append((of, phrase, f, [c for _, c in stack[:-1]]))
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["lang", "phrase", "f", "parts"])


def stream(counts: DataFrame, scratch: Scratch, path: Column, name: str) -> DataFrame:
    """(lang, phrase, f, parts): the counts of the parts of 1, 2, ... words that a phrase begins
    with in the order of ``path`` (the array of its words, from the first or from the last)."""
    parts = _parts(counts.sparkSession)
    rows = counts.where("m > 0").select("lang", path.alias("path"), "phrase", "f")
    rows = rows.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path").withColumn("range", F.spark_partition_id())
    rows = scratch.put(rows, name)
    # what a range's first phrase begins with lies in ranges before it: a few rows a range
    heads = rows.groupBy("range").agg(F.min(F.struct("lang", "path")).alias("head")).where("size(head.path) > 1")
    heads = heads.select("range", "head.lang", F.explode(F.transform(F.sequence(F.lit(1), F.size("head.path") - 1), lambda k: F.slice("head.path", F.lit(1), k))).alias("path"))
    carried = rows.drop("range").join(heads, ["lang", "path"]).select("lang", "path", "phrase", "f", "range", F.lit(True).alias("carried"))
    both = rows.withColumn("carried", F.lit(False)).unionByName(carried)
    return both.repartition(parts, "range").sortWithinPartitions("range", "lang", "path").drop("range").mapInArrow(_walk, "lang string, phrase string, f long, parts array<long>")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    scratch = Scratch(docs.sparkSession)
    counts = phrase_counts(docs, scratch, lang, text, least)
    words = F.split("phrase", " ")
    left = stream(counts, scratch, words, "prefix").withColumnRenamed("parts", "lefts")
    right = stream(counts, scratch, F.reverse(words), "suffix").select("lang", "phrase", F.col("parts").alias("rights"))
    both = scratch.put(left.join(right.hint("merge"), ["lang", "phrase"]).where("size(lefts) > 0"), "both")

    first, rest = (F.regexp_replace("phrase", p, "") for p in ("[ ][^ ]*$", "^[^ ]*[ ]"))
    inside = lambda c, part: both.where(F.element_at(c, -1) == F.col("f")).select("lang", part.alias("phrase"))
    dropped = inside("lefts", first).unionByName(inside("rights", rest)).distinct()
    kept = both.join(dropped, ["lang", "phrase"], "left_anti")
    kept = kept.join(counts.where("m = 0").select("lang", F.col("f").alias("n")), "lang")

    wide = lambda c: c.cast("decimal(19,0)")
    k = "transform(sequence(1, size(lefts)), k -> named_struct('k', k, 'l', lefts[k - 1], 'r', rights[size(lefts) - k]))"
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "n", F.explode(F.expr(k)).alias("x")).select("lang", "phrase", "a", "n", "x.*")
    over = wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)")
    scored = cuts.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", (wide(F.col("l")) * wide(F.col("r"))).cast("decimal(38,0)")).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    return best.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

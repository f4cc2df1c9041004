"""Near duplicates by bottom-k sketches from one hash function.

A text's set are its distinct three-word shingles, by one hash each. Its sketch are the k smallest
values, k = n - ceil(t n) + 1 for n shingles: of two sets of Jaccard similarity t or more, one
value at least is in both sketches, whatever weighs into the values. So a value begins with the
level (a half power of two) of its hash bucket's count over all texts: rare shingles come first,
and a phrase or line that many documents share makes no long list unless the documents consist
of such lines.

Inverted lists of the retained values generate overlaps. The union sketch of two sets are the
values up to the lower of the two sketches' ends: up to there both are known, so it estimates
the similarity by the share of common values, and the most it can be follows with certainty from
that count and the sizes of both rests. Pairs below t by it are left out; all others are verified
on the exact sets of the whole texts. No link is lost, and none is listed unverified.

In two rounds every class of equal sets is compared with one other, the most shared one of its lists
(a family's model); links join classes to components. Then only lists that still hold several
components are searched. In short ones pairs are formed by a join, those of which the value can be the
first common one, and the overlap of their sketches is counted over the lists. Classes of longer lists are
dealt, each once, to tiles of at most ``TILE`` similar classes; two tiles are compared if they
have a list in common, can have similar sizes and don't belong to one component, by the overlaps
of the whole sets; of the links between them those stay that join something. So a family of c
copies costs about c checks, no list is in one task, and no pair is compared twice for the lists it shares.

Null, empty or white-space texts have an empty set: one row, no link. Repeated rows are copies
like others, null ids too; an id with several texts has a row for each. Ties between models are
broken by the class id. Texts are taken whole; extra columns are ignored; an empty table gives an
empty table. Class ids are 64-bit hashes of sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .ngram_join import _heads, class_texts, set_id, verified
from .tables import Scratch

WIDTH = 3
NUM, DEN = 17, 20  # 0.85
BUCKET_BITS = 23  # of the table of levels: 8 MB in a worker, whatever the corpus
SLICE_BITS = 15
ROUNDS = 2
SHORT = 32  # rows of a list whose pairs are formed by a join
TILE = 256
RARE = 20  # levels below: buckets of less than 1,024 rows, so a list of theirs is as short
SIEVE = 1 << 24
COLUMNS = 1 << 14
_U = np.uint64


def kept_values(n: int, num: int, den: int) -> int:
    """k for a set of n: any set of similarity num/den shares one of the k smallest values."""
    return n - -(-num * n // den) + 1


def level(counts: np.ndarray) -> np.ndarray:
    """0 .. 127, twice the binary logarithm of a bucket's count."""
    return np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def sketch(s: np.ndarray, levels: np.ndarray, bits: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The bottom-k sketch of a set of 64-bit shingle hashes: sorted values of 7 bits for the
    level of the hash's bucket and 57 of the hash."""
    of = levels[(s >> _U(64 - bits)).astype(np.int64)].astype(_U)
    v = np.unique(of << _U(57) | s >> _U(7))
    return v[: kept_values(len(v), num, den)] if len(v) else v


def union_sketch(x: np.ndarray, y: np.ndarray, n: int, m: int) -> tuple[int, int, int]:
    """Of two sketches of sets of n and m values: common values and values in the union up to the
    lower end, and the largest overlap that the sets can have."""
    low = min(x[-1], y[-1])
    a, b = int(np.searchsorted(x, low, "right")), int(np.searchsorted(y, low, "right"))
    both = int(np.isin(x[:a], y[:b], assume_unique=True).sum())
    return both, a + b - both, both + min(n - a, m - b)


def _profile(bits: int):
    """(key, t, sid, n) of every row, and a last batch with the task's counts of all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        names, size = ["key", "t", "sid", "n", "slice", "counts"], 1 << min(SLICE_BITS, bits)
        for batch in batches:
            sid, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, s in W.sets(W.column(batch, "text"), WIDTH):
                sid[row], n[row] = set_id(s), len(s)
                of, c = np.unique((s >> _U(64 - bits)).astype(np.int64), return_counts=True)
                counts[of] += c.astype(np.uint32)
            nothing = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([W.column(batch, "key"), W.column(batch, "t"), pa.array(sid), pa.array(n), *nothing], names)
        packed = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(counts.reshape(-1, size)) if x.any()]
        nothing = [pa.nulls(len(packed), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([k for k, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], names)

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of buckets in order of their slice -> the levels of each slice."""
    row = lambda at, x: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level(x).tobytes()], pa.binary())], ["slice", "levels"])
    at, total = None, None
    for batch in batches:
        for k, x in zip(W.column(batch, "slice").to_pylist(), W.column(batch, "counts").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
            if k == at:
                total += x
            else:
                if at is not None:
                    yield row(at, total)
                at, total = k, x
    if at is not None:
        yield row(at, total)


def _sketches(table, bits: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(table.value, np.uint8)
        last = None
        for batch in batches:
            sids, sizes, packed = [], [], []
            for _, s in W.sets(W.column(batch, "text"), WIDTH):
                sid = set_id(s)
                if len(s) and sid != last:
                    last = sid
                    sids.append(sid)
                    sizes.append(len(s))
                    packed.append(sketch(s, levels, bits, num, den).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["sid", "n", "sketch"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes -> a row for every retained value, with its place in the sketch."""
    for batch in batches:
        data, at = W.flat(W.column(batch, "sketch"))
        k = np.diff(at) >> 3
        h = np.frombuffer(data.tobytes(), np.int64)
        place = np.arange(len(h)) - np.repeat(at[:-1] >> 3, k)
        sid, n = (np.repeat(W.column(batch, c).to_numpy(), k) for c in ("sid", "n"))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(sid), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], ["h", "sid", "n", "place"])


def _possible(num: int, den: int):
    """Pairs whose union sketch admits the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (W.column(batch, c).to_pylist() for c in ("sketch_a", "sketch_b"))
            n, m = (W.column(batch, c).to_numpy() for c in ("n_a", "n_b"))
            keep = (n * num <= m * den) & (m * num <= n * den)
            for k in np.flatnonzero(keep):
                _, _, most = union_sketch(np.frombuffer(x[k], _U), np.frombuffer(y[k], _U), int(n[k]), int(m[k]))
                keep[k] = most * (num + den) >= num * (n[k] + m[k])
            yield pa.RecordBatch.from_arrays([W.column(batch, c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def possible(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return pairs.mapInArrow(_possible(num, den), "a long, b long")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common values of every sketch in x with every one in y."""
    values, counts = np.unique(np.concatenate([np.unique(np.concatenate(x)), np.unique(np.concatenate(y))]), return_counts=True)
    values = values[counts > 1]
    out = np.zeros((len(x), len(y)), np.float32)
    for k in range(0, len(values), COLUMNS):
        part = values[k : k + COLUMNS]
        sides = []
        for group in (x, y):
            m = np.zeros((len(group), len(part)), np.float32)
            for row, v in enumerate(group):
                v = v[np.searchsorted(v, part[0]) : np.searchsorted(v, part[-1], "right")]
                at = np.searchsorted(part, v)
                m[row, at[part[at] == v]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def tile_links(x: list[tuple], y: list[tuple], same: bool, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Rows (sid, label, n, set) of two tiles -> links between different components, as many
    as join them: one that leads nowhere new is left out."""
    sid, label, n = (np.array([r[c] for r in x]) for c in range(3))
    sid2, label2, n2 = (np.array([r[c] for r in y]) for c in range(3))
    both = overlaps([r[3] for r in x], [r[3] for r in y])
    total = n[:, None] + n2[None, :]
    ok = (label[:, None] != label2[None, :]) & (both > 0) & (both * (num + den) >= num * total)
    above: dict[int, int] = {}

    def top(k: int) -> int:
        while above.get(k, k) != k:
            k = above[k]
        return k

    for i, j in zip(*np.nonzero(np.triu(ok, 1) if same else ok), strict=True):
        p, q = top(int(label[i])), top(int(label2[j]))
        if p != q:
            above[max(p, q)] = min(p, q)
            yield int(sid[i]), int(sid2[j])


def _rare(num: int, den: int):
    """Rows sorted by (h, n) -> those with another one of their list that is of a similar size. A
    list is short here: its values are rare."""

    def kept(rows: pa.RecordBatch) -> pa.RecordBatch:
        h, n = (W.column(rows, c).to_numpy().astype(np.int64) for c in ("h", "n"))
        near = (h[1:] == h[:-1]) & (n[1:] * num <= n[:-1] * den)
        return rows.filter(pa.array(np.append(near, False) | np.insert(near, 0, False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last list so far
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            h = W.column(rows, "h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield kept(rows.slice(0, cut))
            held = [rows.slice(cut)]
        if held:
            yield kept(held[0])

    return run


def _tiles(size: int):
    """Sorted rows -> with ``cut``: a number that changes with the band and after ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, cut = None, 0, 0
        for batch in batches:
            cuts = np.zeros(batch.num_rows, np.int64)
            for k, at in enumerate(W.column(batch, "band").to_pylist()):
                if at != last or held == size:
                    cut, held, last = cut + 1, 0, at
                held += 1
                cuts[k] = cut
            yield batch.append_column("cut", pa.array(cuts))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [s.tobytes() for _, s in W.sets(W.column(batch, "text"), WIDTH)]
        yield pa.RecordBatch.from_arrays([W.column(batch, "sid"), pa.array(found, pa.binary())], ["sid", "shingles"])


def _searched(num: int, den: int):
    """Rows sorted by (ta, tb, side) -> links (a, b)."""

    def links(at, rows: list[list]) -> pa.RecordBatch:
        same = at[0] == at[1]
        found = list(tile_links(rows[0], rows[0] if same else rows[1], same, num, den))
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, [[], []]
        for batch in batches:
            for ta, tb, side, sid, label, v in zip(*(W.column(batch, c).to_pylist() for c in ("ta", "tb", "side", "sid", "label", "shingles")), strict=True):
                if at is not None and (ta, tb) != at:
                    yield links(at, rows)
                    rows = [[], []]
                at = ta, tb
                rows[side].append((sid, label, len(v) >> 3, np.frombuffer(v, _U)))
        if at is not None:
            yield links(at, rows)

    return run


def long_links(lists: DataFrame, docs: DataFrame, known: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Links of the long lists, by tiles."""
    parts = _parts(lists)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num)) + 1e-9)  # similar sizes are at most one apart
    rows = lists.groupBy("sid").agg(F.min("h").alias("h"), F.first("label").alias("label"), F.first("n").alias("n")).select("h", band.alias("band"), "label", "sid")
    order = ["band", "h", "label", "sid"]
    cut = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_tiles(TILE), "h long, band long, label long, sid long, cut long")
    tiled = scratch.put(cut.select("sid", "label", "band", (F.spark_partition_id().cast("long") * (1 << 40) + F.col("cut")).alias("tile")), "tiled")
    tiles = tiled.groupBy("tile").agg(F.min("band").alias("band"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    there = scratch.put(lists.select("h", "sid").join(tiled.select("sid", "tile"), "sid").select("h", "tile").distinct().join(tiles, "tile"), "there")
    x, y = (there.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("tile", "band", "lo", "hi")]) for side in ("a", "b"))
    units = x.join(y, "h").where("tile_a <= tile_b AND abs(band_a - band_b) <= 1 AND NOT (lo_a = hi_a AND lo_b = hi_b AND lo_a = lo_b)")
    units = scratch.put(units.select(F.col("tile_a").alias("ta"), F.col("tile_b").alias("tb")).distinct(), "units")
    sides = units.select("ta", "tb", F.lit(0).alias("side"), F.col("ta").alias("tile")).unionByName(units.where("ta != tb").select("ta", "tb", F.lit(1).alias("side"), F.col("tb").alias("tile")))
    used = tiled.join(sides.select("tile").distinct(), "tile", "left_semi")
    sets = scratch.put(texts_of(docs, known, used.select("sid")).mapInArrow(_sets, "sid long, shingles binary"), "sets")
    dealt = sides.join(used.select("tile", "sid", "label"), "tile").join(sets, "sid").select("ta", "tb", "side", "sid", "label", "shingles")
    found = scratch.put(dealt.repartition(parts, "ta", "tb").sortWithinPartitions("ta", "tb", "side").mapInArrow(_searched(num, den), "a long, b long"), "far")
    scratch.drop(tiled, there, units, sets)
    return found


def texts_of(docs: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text) of the classes in ``wanted``. A bitmap of ``SIEVE`` bits, 2 MB at any scale, of
    the wanted texts' hashes keeps most others out of the shuffle; a full one only keeps out fewer."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE))
    named = known.join(wanted.distinct(), "sid", "left_semi")
    bits = named.select(slot("low_t").alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    number, place = F.bitmap_bucket_number(slot("t")), F.bitmap_bit_position(slot("t"))
    near = docs.join(F.broadcast(bits), number == F.col("bucket"))  # at most SIEVE / 32,768 rows of 4 KB
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = near.where(byte.bitwiseAND(F.pow(F.lit(2.0), place % 8).cast("int")) != 0).select("key", "text", "t")
    return class_texts(near, named, wanted)


def judged(pairs: DataFrame, classes: DataFrame, docs: DataFrame, known: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) those that are links: the union sketch admits them and the sets confirm them."""
    both = lambda p: p.select(F.col("a").alias("sid")).unionByName(p.select(F.col("b").alias("sid"))).distinct()
    pairs = scratch.put(pairs, "pairs")
    near = scratch.put(possible(pairs, classes.join(both(pairs), "sid", "left_semi"), num, den), "near")
    texts = scratch.put(texts_of(docs, known, both(near)), "texts")
    links = scratch.put(verified(near, texts, num, den, WIDTH), "links")
    scratch.drop(pairs, near, texts)
    return links


def short_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components that the short ones of the lists admit: the value can
    be the first common one, and the sketches have enough in common."""
    many = lists.where(F.col("c") > SHORT).groupBy("sid").agg(F.count("*").alias("more"))  # values not counted below
    x, y = (lists.where(F.col("c") <= SHORT).select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("sid", "label", "n", "place")]) for side in ("a", "b"))
    first = F.max(F.expr(f"least(n_a - place_a, n_b - place_b) * {num + den} >= {num} * (n_a + n_b)")).alias("first")
    pairs = x.join(y, "h").where(f"sid_a < sid_b AND label_a != label_b AND n_a * {num} <= n_b * {den} AND n_b * {num} <= n_a * {den}")
    pairs = pairs.groupBy(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).agg(F.count("*").alias("both"), first, F.max("n_a").alias("n"), F.max("n_b").alias("m")).where("first")
    for side in ("a", "b"):
        pairs = pairs.join(many.select(F.col("sid").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    rest = f"ceil({num} * greatest(n, m) / {den}) - 1"  # of the set whose sketch ends first, at most
    return pairs.where(f"(both + least(coalesce(more_a, 0), coalesce(more_b, 0)) + {rest}) * {num + den} >= {num} * (n + m)").select("a", "b")


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, bits: int = BUCKET_BITS) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; the similarity is num/den or more."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    profile = scratch.put(docs.mapInArrow(_profile(bits), "key long, t long, sid long, n long, slice int, counts binary"), "profile")
    rows = profile.where("slice IS NULL").select("key", "t", "sid", "n")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sliced = profile.where("slice IS NOT NULL").select("slice", "counts").repartition(parts, "slice").sortWithinPartitions("slice")
    levels = np.zeros(1 << bits, np.uint8)
    for row in sliced.mapInArrow(_levels, "slice int, levels binary").toLocalIterator():  # a table of a fixed size
        levels[row.slice * len(row.levels) : (row.slice + 1) * len(row.levels)] = np.frombuffer(row.levels, np.uint8)
    high = spark.sparkContext.broadcast(levels.tobytes())

    low = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("low")
    known = scratch.put(rows.where("n > 0").groupBy("sid").agg(low).select("sid", F.col("low.key").alias("low"), F.col("low.t").alias("low_t")), "known")
    made = docs.select("text").mapInArrow(_sketches(high, bits, num, den), "sid long, n long, sketch binary")
    classes = scratch.put(made.groupBy("sid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    posted = classes.mapInArrow(_postings, "h long, sid long, n int, place int")
    rare = F.call_function("shiftrightunsigned", "h", F.lit(57)) < RARE
    shared = posted.where(rare).repartition(parts, "h").sortWithinPartitions("h", "n").mapInArrow(_rare(num, den), posted.schema)
    shared = scratch.put(shared.unionByName(posted.where(~rare)), "shared")
    counts = shared.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    fame = scratch.put(shared.join(counts, "h").groupBy("sid").agg(F.sum("c").alias("fame")), "fame")  # a family's model shares the most

    links, tried = None, None
    labelled = shared.join(fame, "sid").select("h", "sid", "fame", F.col("n").cast("long").alias("n"), "place", F.col("sid").alias("label"))
    labelled = scratch.put(labelled, "labelled")
    sizes = classes.select(F.col("sid").alias("hub"), F.col("n").alias("m"))
    for _ in range(ROUNDS):
        votes = labelled.join(_heads(labelled), "h").where("label != hub_label").groupBy("sid", "hub").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        if tried is not None:
            votes = votes.join(tried, ["sid", "hub"], "left_anti")
        star = scratch.put(votes.groupBy("sid").agg(F.max_by(F.struct("hub", "c", "n"), F.struct("c", "hub")).alias("x")).select("sid", "x.*"), "star")
        likely = star.join(sizes, "hub").where(f"(c + ceil({num} * n / {den}) - 1) * {num + den} >= {num} * (n + m)")
        new = judged(likely.select(F.col("sid").alias("a"), F.col("hub").alias("b")), classes, docs, known, scratch, num, den)
        links = new if links is None else links.unionByName(new)
        tried = star.select("sid", "hub") if tried is None else tried.unionByName(star.select("sid", "hub"))
        roots = components(links, scratch=scratch).withColumnRenamed("node", "sid")
        before = labelled
        labelled = scratch.put(before.drop("label").join(roots, "sid", "left").withColumn("label", F.coalesce("root", "sid")).drop("root"), "labelled")
        scratch.drop(before)
    lists = scratch.put(labelled.join(_heads(labelled), "h").select("h", "sid", "label", "n", "place", "c"), "lists")
    scratch.drop(labelled, shared)
    short = judged(short_pairs(lists, num, den), classes, docs, known, scratch, num, den)
    long = long_links(lists.where(F.col("c") > SHORT), docs, known, scratch, num, den)
    scratch.drop(lists, classes)
    roots = components(links.unionByName(short).unionByName(long), scratch=scratch)

    sized = known.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lows = sized.groupBy("root").agg(F.min("low").alias("component_id"))
    of = sized.select("sid", "root").join(lows, "root").select("sid", "component_id")
    out = rows.join(of, "sid", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))

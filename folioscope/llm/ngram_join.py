"""N-gram Jaccard join: shingle groups as count vectors, an R-tree over them, exact checks.

Every text is a set of five-word shingle hashes. Texts with equal sets are one class.
Hashing the shingles of a class into groups gives a point of group counts; the overlap of
two classes is at most the sum of the coordinates' minima, so an R-tree whose boxes keep
the maxima of their points (and their sizes) discards pairs of whole boxes at once.

An R-tree over the corpus would sit in one place, so points first go to lossless blocks:
two sets of Jaccard similarity t share at least one of their first n - ceil(t n) + 1
shingles in any common order. The order is by hash, with the shingles of crowded hash
buckets (counted over all texts) last, so that a passage that many documents share does
not make a large block; any choice of crowded buckets gives the same result.

First rounds pair every class with one other, the most shared of its blocks (in a family of
near copies, its model). Their links join classes to components; then blocks that hold
different components are searched, small ones pair by pair and larger ones through an
R-tree each. In all rounds pairs must pass the bound of the count vectors and are then
verified on the exact sets of the texts. Pairs within one component are not listed, which
keeps a group of k copies at about k checks.

A vector has 8 to 16 groups per shingle and is kept as the packed steps between its occupied
groups, less than a byte per shingle: with so many groups the bound is close to the overlap, so
few texts are fetched for pairs that then fail. Groups are ranges of the hash, so a coarser
vector, as the tree's boxes use it, is a fold of the same points.

Null, empty or white-space texts have an empty set: one row, no link. Repeated rows are
copies like others. Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .tables import Scratch

BUCKET_BITS = 20
CROWDED = 64
STAR_ROUNDS = 2
LEAF, FANOUT = 32, 8
TREE_FROM = 8  # smaller blocks are paired directly
STAR_YIELD = 0.1  # another round of pairs with hubs if the last linked at least this share of the classes
SPREAD = 512  # rows of a block's main component in one lot
SHARES = 8  # lots for the blocks of one hub and slot
HELD = 1 << 16  # rows of a block that are held to count it; a larger one is counted in parts


def _limits(num: int, den: int):
    """Prefix length of a set of n shingles, and the test of an overlap, for num/den."""
    prefix = lambda n: n - -(-num * n // den) + 1
    enough = lambda both, total: both * (num + den) >= num * total
    return prefix, enough


def set_id(s: np.ndarray) -> int:
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        h = W.mix64(s * np.uint64(0x9FB21C651E98DF25)).sum() + np.uint64(len(s)) * np.uint64(0xE7037ED1A0B428DB)
        return int(W.mix64(np.array([h], np.uint64)).view(np.int64)[0])


def count_vector(s: np.ndarray) -> bytes:
    """The set's counts by hash group: the number of bits that name a group, then, packed, the
    steps between the groups of the (sorted) shingles, 255 for each 255 and then the rest."""
    bits = max(10, (8 * len(s)).bit_length())
    times, rest = np.divmod(np.diff((s >> np.uint64(64 - bits)).astype(np.int64), prepend=0), 255)
    out = np.full(len(s) + int(times.sum()), 255, np.uint8)
    out[np.cumsum(times + 1) - 1] = rest
    return bytes([bits]) + zlib.compress(out.tobytes(), 1)


def groups(v: bytes) -> tuple[int, np.ndarray]:
    """Bits and the sorted groups of a count vector; a group is listed once per count."""
    x = np.frombuffer(zlib.decompress(v[1:]), np.uint8)
    return v[0], np.cumsum(x, dtype=np.int64)[x != 255]


def _numbered(x: np.ndarray) -> np.ndarray:
    """Sorted groups -> distinct numbers, of the group and of its occurrence."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return (x << 20) + np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))


def minima(v: tuple[int, np.ndarray], w: tuple[int, np.ndarray]) -> int:
    """Sum of the coordinates' minima of two count vectors, over the coarser one's groups."""
    bits = min(v[0], w[0])
    a, b = _numbered(v[1] >> (v[0] - bits)), _numbered(w[1] >> (w[0] - bits))
    if not len(a):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _dense(v: tuple[int, np.ndarray], g: int) -> np.ndarray:
    return np.bincount(v[1] >> (v[0] - g.bit_length() + 1), minlength=g).astype(np.int32)


def _fold(v: np.ndarray, g: int) -> np.ndarray:
    """The same counts over g groups, which are ranges of finer ones."""
    while v.shape[-1] > g:
        v = v[..., ::2] + v[..., 1::2]
    return v


class CountVectorTree:
    """A packed R-tree over count vectors, for one block.

    Points are packed as in sort-tile packing: slabs by size, and within a slab by the hash group
    whose counts differ most; ``LEAF`` of them make a leaf, and ``FANOUT`` nodes the next level's
    node. A node has the maxima of its points' counts (its box), their range of sizes and their
    range of labels. ``pairs`` walks pairs of nodes from the root down and lists the pairs of
    points whose bound admits the similarity and whose labels differ.
    """

    def __init__(self, sizes: np.ndarray, vectors: list[tuple[int, np.ndarray]], labels: np.ndarray, num: int = 3, den: int = 4) -> None:
        self.num, self.den, self.sizes, self.labels = num, den, sizes, labels
        order, slab = np.argsort(sizes, kind="stable"), LEAF * FANOUT
        leaves = []
        for k in range(0, len(order), slab):
            rows = order[k : k + slab]
            g = 1 << max(6, (int(sizes[rows[0]]) // 2).bit_length())  # about two shingles to a group
            points = np.stack([_dense(vectors[r], g) for r in rows])
            by = np.argsort(points[:, points.var(0).argmax()], kind="stable")
            leaves += [self._node(points[by[j : j + LEAF]].max(0), rows[by[j : j + LEAF]], points[by[j : j + LEAF]]) for j in range(0, len(rows), LEAF)]
        level = leaves
        while len(level) > 1:
            level = [self._over(level[k : k + FANOUT]) for k in range(0, len(level), FANOUT)]
        self.root = level[0] if level else None

    def _node(self, box: np.ndarray, rows: np.ndarray, points: np.ndarray) -> dict:
        n, label = self.sizes[rows], self.labels[rows]
        return {"box": box, "least": n.min(), "most": n.max(), "low": label.min(), "high": label.max(), "rows": rows, "points": points}

    @staticmethod
    def _over(nodes: list[dict]) -> dict:
        g = min(len(x["box"]) for x in nodes)
        box = np.max([_fold(x["box"], g) for x in nodes], 0)
        ends = {c: f(x[c] for x in nodes) for c, f in (("least", min), ("most", max), ("low", min), ("high", max))}
        return {"box": box, "nodes": nodes} | ends

    def _apart(self, x: dict, y: dict) -> bool:
        """No pair of the two nodes' points is similar enough, or all have one label."""
        num, den = self.num, self.den
        if x["least"] * num > y["most"] * den or y["least"] * num > x["most"] * den or x["low"] == x["high"] == y["low"] == y["high"]:
            return True
        g = min(len(x["box"]), len(y["box"]))
        return np.minimum(_fold(x["box"], g), _fold(y["box"], g)).sum() * (num + den) < num * (x["least"] + y["least"])

    def pairs(self) -> Iterator[tuple[int, int]]:
        todo = [(self.root, self.root)] if self.root else []
        while todo:
            x, y = todo.pop()
            if self._apart(x, y):
                continue
            if "nodes" in x and x is y:
                todo += [(p, q) for k, p in enumerate(x["nodes"]) for q in x["nodes"][k:]]
            elif "nodes" in x or "nodes" in y:
                todo += [(p, q) for p in x.get("nodes", [x]) for q in y.get("nodes", [y])]
            else:
                yield from self._points(x, y)

    def _points(self, x: dict, y: dict) -> Iterator[tuple[int, int]]:
        num, den, g = self.num, self.den, min(len(x["box"]), len(y["box"]))
        p, q = _fold(x["points"], g), _fold(y["points"], g)
        n2, labels2 = self.sizes[y["rows"]], self.labels[y["rows"]]
        for k, row in enumerate(x["rows"]):
            n = self.sizes[row]
            ok = (labels2 != self.labels[row]) & (n2 * num <= n * den) & (n * num <= n2 * den)
            if x is y:
                ok[: k + 1] = False
            if ok.any():
                ok[ok] = np.minimum(q[ok], p[k]).sum(1) * (num + den) >= num * (n + n2[ok])
                for j in np.flatnonzero(ok):
                    yield int(row), int(y["rows"][j])


def _profile(key: str, text: str, bits: int):
    """(sid, n, vector) of every row, and a last batch with the crowded buckets of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        names = ["key", "t", "sid", "n", "vector", "bucket", "cnt"]
        for batch in batches:
            sid, n, vectors = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), []
            for row, s in W.sets(W.column(batch, text)):
                sid[row], n[row] = set_id(s), len(s)
                vectors.append(count_vector(s) if len(s) else None)
                counts[(s >> np.uint64(64 - bits)).astype(np.int64)] += 1
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([W.column(batch, key).cast(pa.int64()), W.column(batch, "t"), pa.array(sid), pa.array(n), pa.array(vectors, pa.binary()), nothing, nothing], names)
        mean = counts.mean()
        at = np.flatnonzero(counts > mean + 3 * np.sqrt(mean) + 3)
        nothing = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(counts[at].astype(np.int64))], names)

    return run


def _ordered(s: np.ndarray, crowded: np.ndarray, bits: int) -> np.ndarray:
    """The set in the common order: crowded buckets last, else by hash."""
    high = crowded[(s >> np.uint64(64 - bits)).astype(np.int64)]
    return np.concatenate([s[~high], s[high]]) if high.any() else s


def _postings(text: str, crowded, bits: int, num: int, den: int):
    prefix, _ = _limits(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, seen = np.unpackbits(crowded.value).astype(bool), set()
        for batch in batches:
            keys, sids = [], []
            for _, s in W.sets(W.column(batch, text)):
                sid = set_id(s)
                if len(s) and sid not in seen:  # copies within a task post once
                    seen.add(sid)
                    keys.append(_ordered(s, high, bits)[: prefix(len(s))])
                    sids.append(np.full(len(keys[-1]), sid))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(np.concatenate(keys))), pa.array(np.concatenate(sids))], ["h", "sid"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, sid) -> those of keys with at least two different sids, each once,
    and the number of the key's sids. A key may run on over batches: its rows are held until
    it ends or they are ``HELD``."""
    held = [np.zeros(0, np.int64)] * 2
    before = None  # last (h, sid) that was counted in part

    def rows(h: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        c = np.repeat(np.diff(np.append(start, len(h))), np.diff(np.append(start, len(h))))
        keep = c > 1
        if before is not None and len(h):
            keep |= h == before[0]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, sid, c)], ["h", "sid", "c"])

    for batch in batches:
        h, sid = (np.concatenate([old, W.column(batch, c).to_numpy()]) for old, c in zip(held, ("h", "sid"), strict=True))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
        if before is not None and len(h):
            new[0] = (h[0], sid[0]) != before
        h, sid = h[new], sid[new]
        end = int(np.searchsorted(h, h[-1])) if len(h) else 0
        if len(h) - end >= HELD:
            end = len(h)
        yield rows(h[:end], sid[:end])
        if end and end == len(h):
            before = (h[-1], sid[-1])
        held = [h[end:], sid[end:]]
    yield rows(*held)


def _bound(num: int, den: int):
    """Pairs whose sizes and summed minima admit the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array(W.column(batch, c).to_pylist(), object) for c in ("vector_a", "vector_b"))
            n, m = (W.column(batch, c).to_numpy() for c in ("n_a", "n_b"))
            keep = (n * num <= m * den) & (m * num <= n * den)
            for k in np.flatnonzero(keep):
                keep[k] = minima(groups(a[k]), groups(b[k])) * (num + den) >= num * (n[k] + m[k])
            yield pa.RecordBatch.from_arrays([W.column(batch, c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return run


def bounded(pairs: DataFrame, vectors: DataFrame, num: int, den: int) -> DataFrame:
    for side in ("a", "b"):
        v = vectors.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("vector").alias(f"vector_{side}"))
        pairs = pairs.join(v, side)
    return pairs.mapInArrow(_bound(num, den), "a long, b long")


def _check(num: int, den: int, width: int = W.WIDTH):
    _, enough = _limits(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (W.column(batch, c).to_numpy() for c in ("a", "b"))
            rows = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
            right = {int(b[rows[k]]): s for k, s in W.sets(W.column(batch, "text_b").take(pa.array(rows, pa.int64())), width)}
            keep = np.zeros(len(a), bool)
            for k, s in W.sets(W.column(batch, "text_a"), width):
                t = right[int(b[k])]
                both = int(np.isin(s, t, assume_unique=True).sum()) if len(s) and len(t) else 0
                keep[k] = both > 0 and enough(both, len(s) + len(t))
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of which equal ids lie side by side -> the first of each id."""
    last = None
    for batch in batches:
        sid = W.column(batch, "sid").to_numpy()
        keep = np.ones(len(sid), bool)
        keep[1:] = sid[1:] != sid[:-1]
        if len(sid):
            keep[0] = int(sid[0]) != last
            last = int(sid[-1])
        yield batch.filter(pa.array(keep))


def _named(rows: DataFrame) -> DataFrame:
    """The columns that name a row's id and text, none of them null."""
    return rows.withColumns({"none": F.col("key").isNull(), "at": F.coalesce("key", F.lit(0)), "hash": F.coalesce("t", F.lit(0))})


def class_texts(docs: DataFrame, classes: DataFrame, some: DataFrame) -> DataFrame:
    """(sid, text) of the classes in ``some``: each one's text of smallest id. The corpus'
    texts are shuffled once, for all rounds."""
    wanted = _named(classes.join(some, "sid", "left_semi").select("sid", F.col("low").alias("key"), F.col("low_t").alias("t"))).select("sid", "none", "at", "hash")
    found = _named(docs).join(wanted.hint("merge"), ["none", "at", "hash"]).select("sid", "text")
    return found.mapInArrow(_once, "sid long, text string")


def verified(pairs: DataFrame, texts: DataFrame, num: int, den: int, width: int = W.WIDTH) -> DataFrame:
    """Pairs (a, b) of classes whose exact sets are similar enough."""
    one = pairs.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_check(num, den, width), "a long, b long")


def _search(num: int, den: int):
    """Rows sorted by (lot, kind, h) -> pairs of different components that neither the R-tree
    nor the finer vectors rule out. A lot holds blocks of one model, which repeat their pairs;
    each is looked at once, and so is each set of classes. Rows of kind 0 are the lot's vectors, those of kind 1 its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, vectors, seen, done = {}, {}, set(), set()
        at, block = None, []

        def pairs(left: list[int], right: list[int]) -> None:
            sid, label, n = (np.concatenate([x[k] for x in block]) for k in range(3))
            same = hashlib.blake2b(np.sort(sid).tobytes(), digest_size=16).digest()
            if same in done:
                return
            done.add(same)
            size = dict(zip(sid.tolist(), n.tolist(), strict=True))
            for x in size:
                if x not in vectors:
                    vectors[x] = groups(packed[x])
            for i, j in CountVectorTree(n, [vectors[x] for x in sid.tolist()], label, num, den).pairs():
                a, b = sorted((int(sid[i]), int(sid[j])))
                if (a, b) not in seen:
                    seen.add((a, b))
                    if minima(vectors[a], vectors[b]) * (num + den) >= num * (size[a] + size[b]):
                        left.append(a)
                        right.append(b)

        for batch in batches:
            lot, kind, h, sid, label, n = (W.column(batch, c).to_numpy() for c in ("lot", "kind", "h", "sid", "label", "n"))
            cuts = np.flatnonzero((lot[1:] != lot[:-1]) | (kind[1:] != kind[:-1]) | (h[1:] != h[:-1])) + 1
            left, right = [], []
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
                if x == y:
                    continue
                if block and at != (lot[x], kind[x], h[x]):
                    pairs(left, right)
                    block = []
                if at is None or at[0] != lot[x]:
                    packed, vectors, seen, done = {}, {}, set(), set()
                at = (lot[x], kind[x], h[x])
                if kind[x]:
                    block.append((sid[x:y], label[x:y], n[x:y]))
                else:
                    packed.update(zip(sid[x:y].tolist(), W.column(batch, "vector").slice(x, y - x).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        if block:
            left, right = [], []
            pairs(left, right)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def similar_components(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 3, den: int = 4, bits: int = BUCKET_BITS) -> DataFrame:
    """(key, n_shingles, component_id) for every row; the similarity is num/den or more."""
    return _components(docs, key, text, num, den, bits).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id")
    )


def _components(docs: DataFrame, key: str, text: str, num: int, den: int, bits: int) -> DataFrame:
    """(key, t, sid, n, root, component_id) for every row: the text's hash, its class, and the
    component's smallest class and smallest id."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    schema = "key long, t long, sid long, n long, vector binary, bucket long, cnt long"
    profile = scratch.put(docs.mapInArrow(_profile("key", "text", bits), schema), "profile")
    rows = scratch.put(profile.where("bucket IS NULL").select("key", "t", "sid", "n"), "rows")
    crowded = np.zeros(1 << bits, bool)  # a fixed number of buckets, whatever the corpus
    full = profile.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("cnt").alias("c")).where(F.col("c") >= CROWDED)
    crowded[[r.bucket for r in full.select("bucket").toLocalIterator()]] = True
    high = spark.sparkContext.broadcast(np.packbits(crowded))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    posted = docs.select("text").mapInArrow(_postings("text", high, bits, num, den), "h long, sid long")
    shared = scratch.put(posted.repartition(parts, "h").sortWithinPartitions("h", "sid").mapInArrow(_shared, "h long, sid long, c long"), "shared")

    low = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "t")).alias("low")
    classes = scratch.put(rows.where("n > 0").groupBy("sid").agg(low).select("sid", F.col("low.key").alias("low"), F.col("low.t").alias("low_t")), "classes")
    some = scratch.put(shared.groupBy("sid").agg(F.sum("c").alias("fame")), "some")  # a family's model shares the most
    vectors = scratch.put(profile.where("n > 0").select("sid", "n", "vector").join(some, "sid", "left_semi").dropDuplicates(["sid"]), "vectors")
    scratch.drop(profile)
    texts = scratch.put(class_texts(docs, classes, some), "texts")
    ranked = scratch.put(shared.select("h", "sid").join(some.join(vectors.select("sid", "n"), "sid"), "sid"), "ranked")
    scratch.drop(shared, some)

    links, tried = None, None
    labelled = scratch.put(ranked.withColumn("label", F.col("sid")), "labelled")
    for _ in range(STAR_ROUNDS):
        # of each block that still holds several components, the most shared class that a row isn't joined to
        votes = labelled.join(_heads(labelled), "h").where("label != hub_label").groupBy("sid", "hub").agg(F.count("*").alias("c"))
        if tried is not None:
            votes = votes.join(tried, ["sid", "hub"], "left_anti")
        star = scratch.put(votes.groupBy("sid").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub")), "star")
        near = scratch.put(bounded(star.select(F.col("sid").alias("a"), F.col("hub").alias("b")), vectors, num, den), "near")
        new = scratch.put(verified(near, texts, num, den), "links")
        scratch.drop(near, labelled)
        links = new if links is None else links.unionByName(new)
        tried = star if tried is None else tried.unionByName(star)
        roots = components(links, scratch=scratch).withColumnRenamed("node", "sid")
        labelled = scratch.put(ranked.join(roots, "sid", "left").select("h", "sid", "fame", "n", F.coalesce("root", "sid").alias("label")), "labelled")
        if new.count() < STAR_YIELD * star.count():
            break
    scratch.drop(ranked)
    blocks = scratch.put(labelled.join(_heads(labelled), "h").select("h", "sid", "label", "n", "hub", "hub_label", "c"), "blocks")
    scratch.drop(labelled)
    small = blocks.where(F.col("c") < TREE_FROM)
    x, y = (small.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("sid", "label", "n")]) for side in ("a", "b"))
    near = x.join(y, "h").where(f"sid_a < sid_b AND label_a != label_b AND n_a * {num} <= n_b * {den} AND n_b * {num} <= n_a * {den}")
    near = bounded(near.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")).distinct(), vectors, num, den)
    large = _dealt(blocks.where(F.col("c") >= TREE_FROM))
    points = large.select("lot", "sid").distinct().join(vectors.select("sid", "vector"), "sid")
    none = F.lit(0).cast("long")
    points = points.select("lot", F.lit(0).alias("kind"), none.alias("h"), "sid", none.alias("label"), none.alias("n"), "vector")
    large = points.unionByName(large.select("lot", F.lit(1).alias("kind"), "h", "sid", "label", "n", F.lit(None).cast("binary").alias("vector")))
    far = scratch.put(large.repartition(parts, "lot").sortWithinPartitions("lot", "kind", "h").mapInArrow(_search(num, den), "a long, b long"), "far")
    found = scratch.put(near.unionByName(far).distinct(), "found")
    scratch.drop(blocks, far, vectors)
    more = scratch.put(verified(found, texts, num, den), "links")
    scratch.drop(found, texts)
    roots = components(links.unionByName(more), scratch=scratch)

    sized = classes.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lows = sized.groupBy("root").agg(F.min("low").alias("component_id"))
    of = sized.select("sid", "root").join(lows, "root").select("sid", "root", "component_id")
    return rows.join(of, "sid", "left").select("key", "t", "sid", "n", "root", "component_id")


def _heads(labelled: DataFrame) -> DataFrame:
    """Of every block that holds several components: its most shared class, that class' label
    and the number of rows. Partial maxima and a join, so no block is gathered in one task."""
    best = F.max(F.struct("fame", "sid", "label")).alias("best")
    heads = labelled.groupBy("h").agg(best, F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo != hi")
    return heads.select("h", F.col("best.sid").alias("hub"), F.col("best.label").alias("hub_label"), "c")


def _dealt(blocks: DataFrame) -> DataFrame:
    """Large blocks dealt to lots, blocks of one hub together. In a block of more than
    ``SPREAD`` rows those of its largest component, which are not compared with each other, are
    dealt over as many lots as it has ``SPREAD`` rows; all others go to each of these. The
    blocks of a hub that has so many rows are dealt over ``SHARES`` more by their key."""
    slots = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("c") / SPREAD, F.lit(1.0))))).cast("long")
    home = F.pmod(F.xxhash64("sid"), F.col("slots"))
    main = blocks.groupBy("h", "label").agg(F.count("*").alias("m")).groupBy("h").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    blocks = blocks.join(main, "h")
    own = F.when(F.col("label") == F.col("main"), F.array(home)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))
    dealt = blocks.withColumn("slots", slots).withColumn("slot", F.explode(own))
    share = F.pmod("h", F.least(F.col("slots"), F.lit(SHARES)))
    return dealt.withColumn("lot", F.xxhash64("hub", "slots", "slot", share)).select("lot", "h", "sid", "label", "n")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 3, den: int = 4) -> DataFrame:
    """``docs`` with one row of every component: that of the smallest id, of no id if none has one.

    Among an id's texts in one component the class and then the hash decide. Texts without
    words are in no component and stay; of rows of one id and text, one. All columns are kept
    (names that begin with ``_kept_`` are ours).
    """
    found = _components(docs, key, text, num, den, BUCKET_BITS)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "sid", "t")).alias("first")
    single = found.where("n > 0").groupBy("root").agg(first).select(F.col("first.key").alias("key"), F.col("first.t").alias("t"))
    keep = single.unionByName(found.where("n = 0").select("key", "t"))
    names = [f"_kept_{c}" for c in ("none", "at", "hash")]
    mark = lambda k, t: [k.isNull().alias(names[0]), F.coalesce(k.cast("long"), F.lit(0)).alias(names[1]), t.alias(names[2])]
    hashed = docs.select("*", *mark(F.col(key), F.xxhash64(F.col(text).cast("string"))))
    # rows meet the decision by one shuffle, and repeated rows each other by the same one
    kept = hashed.join(keep.select(*mark(F.col("key"), F.col("t"))).distinct(), names, "left_semi")
    return kept.dropDuplicates(names).drop(*names)

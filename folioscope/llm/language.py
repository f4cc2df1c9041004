"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text recognises all its substrings. A text
is parsed against it from left to right into longest matches; the fewer phrases it needs
per byte, the closer the language. Parsing runs in lockstep: all segments of a block and
all languages advance one byte at a time, over dense transition tables.

Texts are lower-cased; runs of bytes that are not letters become one space. Texts are parsed
whole. To advance in lockstep a long text is cut into segments of ``SEGMENT`` bytes, which changes no phrase: each is parsed
from the root first, then again from the state in which the one before it ends, until
the two parses are in the same state, and so on until no segment's end changes. Counts are divided by those
expected: one for the phrase open at the end, and by length what each language's
held-back text needs against its own automaton (a language whose text is richer, or of
which less is known, needs more): the sample is cut into ``FOLDS`` runs of bytes, each is
parsed against an automaton of the others in parts of ``SEGMENT`` bytes, and the median over these, 1 at most, is
kept, so that near copies within a sample don't decide. A sample of one document is cut
likewise; one of fewer than ``FOLDS`` bytes counts as a phrase per byte.

Every language that has a text with a letter is learned. Training takes at most
``SAMPLE_BYTES`` bytes of whole documents per language, those of the smallest text hash,
and at most ``SAMPLE_DOCS`` documents: a bounded sample. Equal texts of a language count
once. Texts of more than ``SAMPLE_BYTES`` bytes come last, the shortest first; a
language with no shorter text learns from its smallest, ``STRETCHES`` stretches of it at even
distances, ``SAMPLE_BYTES`` bytes in all, so that no automaton is larger than that. Automata are built by
language in parallel and scored in blocks of ``BLOCK`` languages, of which the best two are
kept; a worker holds all languages' transitions in compact form (about half a MB each) and
the dense tables of one block.

The prediction is ``und`` with score 0 for a null text, one without letters, or if there is
nothing to learn from. Ties go to the smaller name. Rows that repeat are predicted alike;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_BYTES = 24_000
SAMPLE_DOCS = 64
SHARES = 16
BLOCK = 16
SEGMENT = 1024
STRETCHES = 16
FOLDS = 4
UNDETERMINED = "und"


def plain(text: str | None) -> bytes:
    """Lower-cased letters, with one space for each run of anything else; empty if no letter."""
    if not text:
        return b""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode("utf-8", "ignore")


class Automaton:
    """A suffix automaton's transitions, state by state; state 0 is the root."""

    def __init__(self, text: bytes) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now


@dataclass(frozen=True)
class Language:
    """One automaton's transitions, in compact form."""

    name: str
    states: int
    source: np.ndarray
    byte: np.ndarray
    target: np.ndarray
    own: float  # phrases per byte of the language's own held-back text


@dataclass(frozen=True)
class Block:
    """Dense tables of some languages."""

    symbols: np.ndarray  # byte -> symbol; 0 is a byte never learned
    table: np.ndarray  # all automata's transitions, flat; 0 is none
    roots: np.ndarray
    width: int


@dataclass(frozen=True)
class Model:
    """Languages by name, in blocks."""

    blocks: list[list[Language]]


def learned(name: str, text: bytes, own: float = 1.0) -> Language:
    states = Automaton(text).next
    source = np.repeat(np.arange(len(states), dtype=np.int32), [len(row) for row in states])
    byte = np.fromiter((c for row in states for c in row), np.uint8, len(source))
    target = np.fromiter((to for row in states for to in row.values()), np.int32, len(source))
    return Language(name, len(states), source, byte, target, own)


def tabulated(languages: list[Language]) -> Block:
    known = np.unique(np.concatenate([x.byte for x in languages]))
    symbols = np.zeros(256, np.int64)
    symbols[known] = np.arange(1, len(known) + 1)
    roots = np.cumsum([1, *[x.states for x in languages]])
    table = np.zeros((roots[-1], len(known) + 1), np.int32)
    for x, base in zip(languages, roots, strict=False):
        table[base + x.source, symbols[x.byte]] = base + x.target
    return Block(symbols, table.ravel(), roots[:-1], len(known) + 1)


def held_back(text: bytes) -> float:
    """Phrases per byte that parts of the text need against the rest of it."""
    if len(text) < FOLDS:
        return 1.0
    cuts, rates = [len(text) * k // FOLDS for k in range(FOLDS + 1)], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        rest = tabulated([learned("", text[:a] + text[b:])])
        parts = [text[k : min(k + SEGMENT, b)] for k in range(a, b, SEGMENT)]
        rates += list((phrases(rest, parts)[:, 0] - 1) / [len(p) for p in parts])
    return min(float(np.median(rates)), 1.0)


def grouped(languages: list[Language]) -> Model | None:
    known = sorted(languages, key=lambda x: x.name)
    return Model([known[k : k + BLOCK] for k in range(0, len(known), BLOCK)]) if known else None


def build(texts: dict[str, list[bytes]]) -> Model | None:
    joined = {k: b" ".join(t for t in v if t) for k, v in texts.items()}
    return grouped([learned(k, t, held_back(t)) for k, t in joined.items() if t])


def _advance(model: Block, flat: np.ndarray, first: np.ndarray, size: np.ndarray, start: np.ndarray, other: np.ndarray | None = None):
    """Parse the ranges of ``flat`` (longest first), all languages in lockstep, from the states ``start``:
    their end states and, of each range and language, the phrases that ended. With ``other`` states a range is parsed from both until they agree: the end
    states from ``start`` (-1: those of the other parse), and the phrases more than from ``other``."""
    langs, width, table = len(model.roots), model.width, model.table
    root_rows = np.stack([table[r * width : (r + 1) * width] for r in model.roots], 1)  # symbol x language
    roots = model.roots[None].astype(np.int32)

    def step(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = table.take(state * width + c[:, None])
        miss = to == 0
        np.copyto(to, root_rows[c], where=miss)
        np.copyto(to, roots, where=to == 0)
        return to.astype(np.int64), miss

    end, count = start.copy(), np.zeros((len(size), langs), np.int64)
    if other is None:
        active = len(size)
        for t in range(int(size[0]) if len(size) else 0):
            while size[active - 1] <= t:
                active -= 1
            end[:active], miss = step(end[:active], model.symbols[flat[first[:active] + t]])
            count[:active] += miss
        return end, count
    lanes, now, then = np.arange(len(size)), start.copy(), other.copy()
    t = 0
    while len(lanes):
        agree, over = (now == then).all(1), size[lanes] <= t
        end[lanes[over]] = now[over]
        end[lanes[agree]] = -1
        rest = ~(agree | over)
        lanes, now, then = lanes[rest], now[rest], then[rest]
        c = model.symbols[flat[first[lanes] + t]]
        now, miss = step(now, c)
        then, missed = step(then, c)
        count[lanes] += miss.astype(np.int64) - missed
        t += 1
    return end, count


def phrases(model: Block, texts: list[bytes]) -> np.ndarray:
    """Phrases that each text needs in each language: (texts, languages)."""
    out = np.zeros((len(texts), len(model.roots)), np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    if not len(flat):
        return out
    length = np.array([len(t) for t in texts])
    parts = -(-length // SEGMENT)
    of = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = (np.cumsum(length) - length)[of] + nth * SEGMENT
    size = np.minimum(length[of] - nth * SEGMENT, SEGMENT)
    order = np.argsort(-size, kind="stable")
    end, count = np.zeros((len(of), len(model.roots)), np.int64), np.zeros((len(of), len(model.roots)), np.int64)
    start = np.tile(model.roots, (len(of), 1)).astype(np.int64)
    end[order], count[order] = _advance(model, flat, first[order], size[order], start[order])
    lanes = np.flatnonzero(nth > 0)  # segments whose predecessor's end is new
    while len(lanes):
        better = end[lanes - 1]
        ends, more = _advance(model, flat, first[lanes], size[lanes], better, start[lanes])
        start[lanes] = better
        count[lanes] += more
        ends = np.where(ends < 0, end[lanes], ends)
        moved = lanes[(ends != end[lanes]).any(1)]
        end[lanes] = ends
        lanes = moved[np.isin(moved + 1, np.flatnonzero(nth > 0))] + 1
    np.add.at(out, of, count)
    return out + (length > 0)[:, None]  # the phrase that is open at the end


def predict(model: Model | None, texts: list[str | None], tables: dict[int, Block] | None = None) -> tuple[list[str], list[float]]:
    """Names and scores. ``tables`` keeps the block's tables between calls if there is one block."""
    plain_texts = [plain(t) for t in texts]
    if model is None:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    tables = {} if tables is None else tables
    length = np.array([len(t) for t in plain_texts]).reshape(-1, 1)
    best, low, second = np.zeros(len(texts), np.int64), np.full(len(texts), np.inf), np.full(len(texts), np.inf)
    for k, block in enumerate(model.blocks):
        if k not in tables:
            tables.clear()
            tables[k] = tabulated(block)
        need = phrases(tables[k], plain_texts) / (length * np.array([x.own for x in block]) + 1)
        here = need.argmin(1)
        least = need[np.arange(len(texts)), here]
        need[np.arange(len(texts)), here] = np.inf
        better = least < low  # ties go to the smaller name
        second = np.minimum(np.where(better, low, least), np.minimum(second, need.min(1)))
        best, low = np.where(better, k * BLOCK + here, best), np.minimum(low, least)
    all_names = [x.name for block in model.blocks for x in block]
    names, scores = [], []
    for t, k, a, b in zip(plain_texts, best, low, second, strict=True):
        names.append(all_names[k] if t else UNDETERMINED)
        scores.append(0.0 if not t else 1.0 if not np.isfinite(b) else float(1 - a / b) if b > 0 else 0.0)
    return names, scores


FITTED = "name string, states long, source binary, byte binary, target binary, own double"


def stretches(text: bytes) -> bytes:
    """All of a text, or of one of more than ``SAMPLE_BYTES`` bytes stretches at even distances."""
    if len(text) <= SAMPLE_BYTES:
        return text
    wide = SAMPLE_BYTES // STRETCHES - 1
    return b" ".join(text[a : a + wide] for a in ((len(text) - wide) * k // (STRETCHES - 1) for k in range(STRETCHES)))


def _fit(table: pa.Table) -> pa.Table:
    """The automaton of one language from its ranked texts."""
    have, size = [], 0
    for row in sorted(table.to_pylist(), key=lambda r: r["r"]):
        t = plain(row["text"])
        if t and (not have or size + len(t) <= SAMPLE_BYTES):
            have.append(t)
            size += len(t)
    text = stretches(b" ".join(have))
    found = [learned(table["lang"][0].as_py(), text, held_back(text))] if text else []
    cols = [[getattr(x, c) for x in found] for c in ("name", "states", "own")] + [[getattr(x, c).tobytes() for x in found] for c in ("source", "byte", "target")]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({c: pa.array(v, kind) for c, v, kind in zip(("name", "states", "own", "source", "byte", "target"), cols, kinds, strict=True)}).select(["name", "states", "source", "byte", "target", "own"])


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Automata from the given rows' text and language."""
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    usable = d.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("*", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    distinct = usable.groupBy("lang", "h", "n").agg(F.min("key").alias("key"))
    over = F.greatest("n", F.lit(SAMPLE_BYTES))  # texts within the budget first, then by length
    # the first of every share of a language, and of these the first: a bounded number of rows
    # meets in one task, whatever the number of texts or of tasks before it
    shares = Window.partitionBy("lang", F.pmod("h", F.lit(SHARES))).orderBy(over, "h", "n")
    distinct = distinct.withColumn("r", F.row_number().over(shares)).where(F.col("r") <= SAMPLE_DOCS).drop("r")
    order = Window.partitionBy("lang").orderBy(over, "h", "n")
    ranked = distinct.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_DOCS)
    # at most SAMPLE_DOCS ids a language; of the rows of one id and text, one
    chosen = F.broadcast(ranked.select(*[F.col(c).alias(f"its_{c}") for c in ("lang", "h", "n", "key")], "r"))
    rows = usable.join(chosen, (F.col("lang") == F.col("its_lang")) & (F.col("h") == F.col("its_h")) & (F.col("n") == F.col("its_n")) & F.col("key").eqNullSafe(F.col("its_key")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    fitted = rows.select("lang", "r", "text").dropDuplicates(["lang", "r"]).repartition(parts, "lang").groupBy("lang").applyInArrow(_fit, FITTED).collect()
    return grouped([Language(r.name, r.states, np.frombuffer(r.source, np.int32), np.frombuffer(r.byte, np.uint8), np.frombuffer(r.target, np.int32), r.own) for r in fitted])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tables = model.value, {}
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            names, scores, block, size = [], [], [], 0
            for t in texts:
                block.append(t)
                size += len(t or "")
                if size > 1 << 22:
                    got = predict(m, block, tables)
                    names, scores, block, size = names + got[0], scores + got[1], [], 0
            got = predict(m, block, tables)
            yield pa.RecordBatch.from_arrays([keys, pa.array(names + got[0], pa.string()), pa.array(scores + got[1], pa.float64())], ["key", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row; the score is one less the ratio of the phrases
    that the best and the second language need."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(_predict(shared), "key long, lang_pred string, score double").withColumnRenamed("key", key)

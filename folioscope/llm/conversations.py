"""Repair of conversations by iterative-deepening A*.

A conversation's rows go by turn. Every row has at most one fault: blank (no character other
than white space), duplicate (its role and text occur earlier in the conversation) or truncated
(the last such character is not . ! or ?). Edits make its roles read s?(ua)+ or nothing: Keep (0),
Rerole to user or assistant (2), Delete (3, the only edit of blank and duplicate rows), Insert an
empty user or assistant row anywhere (2); a truncated row that stays costs 1 more. Where the
role may go is decided by the last one, so a script of initials says all.

``cheapest`` is the search: depth first in ASCII order of the edits (D, I, K, R) under a cost
bound; a bound that fails is raised by one. Costs to come are bounded from below by the faults
ahead. States (row, last role) that failed with a budget are kept, over all bounds, and not
entered again with no more. The first accepting path of the first bound that
has one is the cheapest script and, among those, the least in ASCII.

A conversation of any length is cut into blocks of at most ``BLOCK`` rows. Short ones are one
block and one search. Of a longer one, every block is searched for the least cost between each
two last roles; these small tables, one row a block, are put together from the end, which gives
what the rest costs after each block; then every block is searched again, with that as its end,
for each last role that it can begin with, and the scripts are chained from the start. A block
ends with its last row, so the chained script is the least one of the whole. Searches run a block
at a time, wherever the conversation's other blocks are. Only the chaining (some twenty numbers a
block) and the digest, which is a stream by its nature, go through a conversation in order, and
neither holds it.

Nulls are one space in roles, texts and the damage's key; rows without a turn come first; rows of
one turn go by role and text (bytes), so repeated rows lie side by side; a null id is a
conversation like others. Empty texts are blank. A conversation without rows has zeros, an empty
audit and the digest of the empty string. Extra columns are ignored; an empty table gives an
empty table; texts of any length are streamed to the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .tables import Scratch

BLOCK = 256
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role of what is repaired so far
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 4, 2, 0)  # inserts that make it a whole conversation
APART = 1 << 60
_WHITE = " \t\n\x0b\f\r"


def _kept(state: int, initial: str) -> int | None:
    """The last role after a row that is kept, if it may follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    want = NEXT[state]
    return want if initial == ("u" if want == USER else "a") else None


def cheapest(initials: str, faults: bytes, begin: int = START, after: tuple[int, ...] | None = None) -> tuple[int, str, int] | None:
    """(cost, script, last role) of the cheapest script, the least in ASCII among those.

    ``after``: what comes after the last row costs so much from each last role, and inserts
    behind it are left to that; without it the rows end the conversation.
    """
    n = len(initials)
    ahead = [0] * (n + 1)  # no script of the rows from i on costs less
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + (0, 3, 3, 1)[faults[i]]
    last = after is None
    least_after = min(END if last else after)
    limit = 3 * n + 8 + max([c for c in (END if last else after) if c < APART], default=0)
    failed: dict[tuple[int, int], int] = {}
    bound = ahead[0] + least_after
    while bound <= limit:
        # frames: row, last role, cost so far, edits still to try
        path: list[str] = []
        stack = [(0, begin, 0, iter("DIKR"))]
        entered = True
        while stack:
            i, state, cost, edits = stack[-1]
            if entered:
                entered = False
                if i == n:
                    whole = state in (START, ASSISTANT) if last else after[state] < APART
                    total = cost + (0 if last else after[state])
                    if whole and total <= bound:
                        return total, "".join(path), state
            step = None
            for edit in edits:
                if edit == "I":
                    if i == n and not last:
                        continue
                    to = i, NEXT[state], cost + 2
                elif i == n:
                    continue
                elif edit == "D":
                    to = i + 1, state, cost + 3
                elif faults[i] in (BLANK, DUPLICATE):
                    continue
                else:
                    role = NEXT[state] if edit == "R" else _kept(state, initials[i])
                    if role is None:
                        continue
                    to = i + 1, role, cost + (2 if edit == "R" else 0) + (faults[i] == TRUNCATED)
                if to[2] + ahead[to[0]] + least_after <= bound and failed.get(to[:2], -1) < bound - to[2]:
                    step = edit, to
                    break
            if step is None:
                failed[i, state] = max(failed.get((i, state), -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
            else:
                path.append(step[0])
                stack.append((*step[1], iter("DIKR")))
                entered = True
        bound += 1
    return None


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a row's checksum decides."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rule = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(rule == 1, "").when(rule == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(rule == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    copies = F.when(rule == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(rule != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faulty(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows in order, (conv, at, turn, role, text, initial, fault): ``at`` grows with the order,
    by one from row to row of a conversation and partition."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    rows = rows.select(conv.alias("conv"), "turn", "role", "text").repartitionByRange(parts, "conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = scratch.put(rows.select(F.monotonically_increasing_id().alias("at"), "conv", "turn", "role", "text", same.alias("same")), "rows")
    first = rows.groupBy("conv", "same").agg(F.min("at").alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(_WHITE))
    fault = (
        F.when(bare == "", BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    )
    kept = rows.join(first, ["conv", "same"]).select("conv", "at", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    return scratch.put(kept, "faulty")


def _blocks(size: int):
    """Rows sorted by (conv, at) -> (conv, block, initials, faults), at most ``size`` rows each;
    rows of one block are neighbours of one partition, so row k of it is at block + k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []

        def row() -> tuple:
            return now[0], now[1], "".join(x if x in ("s", "u", "a") else "-" for x in now[2]), bytes(now[3])

        for batch in batches:
            out = []
            for conv, at, initial, fault in zip(*(W.column(batch, c).to_pylist() for c in ("conv", "at", "initial", "fault")), strict=True):
                if now and (conv != now[0] or at != now[1] + len(now[2]) or len(now[2]) == size):
                    out.append(row())
                    now = []
                if not now:
                    now = [conv, at, [], []]
                now[2].append(initial)
                now[3].append(fault)
            yield _batch(out, BLOCKS)
        if now:
            yield _batch([row()], BLOCKS)

    return run


BLOCKS = {"conv": pa.string(), "block": pa.int64(), "initials": pa.string(), "faults": pa.binary()}
SCRIPTS = {"conv": pa.string(), "block": pa.int64(), "cost": pa.int64(), "script": pa.string(), "state": pa.int32()}


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], list(kinds))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(W.column(batch, c).to_pylist() for c in ("conv", "block", "initials", "faults")), strict=True)
        yield _batch([(conv, block, *cheapest(initials, faults)[:2], START) for conv, block, initials, faults in rows], SCRIPTS)


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> the least cost from each last role before to each one behind them."""
    for batch in batches:
        rows = zip(*(W.column(batch, c).to_pylist() for c in ("conv", "block", "initials", "faults")), strict=True)
        out = []
        for conv, block, initials, faults in rows:
            costs = [APART] * 16
            for p in range(4):
                for q in (USER, ASSISTANT):
                    found = cheapest(initials, faults, p, tuple(0 if k == q else APART for k in range(4)))
                    costs[4 * p + q] = found[0] if found else APART
            gone = 3 * len(initials)  # before the first user only deletes, and one system row at most
            costs[4 * START + START] = costs[4 * SYSTEM + SYSTEM] = gone
            systems = [f == TRUNCATED for x, f in zip(initials, faults, strict=True) if x == "s" and f in (NONE, TRUNCATED)]
            costs[4 * START + SYSTEM] = gone - 3 + min(systems) if systems else APART
            out.append((conv, block, costs))
        yield _batch(out, {"conv": pa.string(), "block": pa.int64(), "costs": pa.list_(pa.int64())})


def _afters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, block, costs) from the last block to the first -> what comes after each block costs."""
    last, after = None, END
    for batch in batches:
        out = []
        for conv, block, costs in zip(*(W.column(batch, c).to_pylist() for c in ("conv", "block", "costs")), strict=True):
            if conv != last:
                last, after = conv, END
            out.append((conv, block, list(after)))
            after = tuple(min(APART, *(costs[4 * p + q] + after[q] for q in range(4))) for p in range(4))
        yield _batch(out, {"conv": pa.string(), "block": pa.int64(), "after": pa.list_(pa.int64())})


def _scripts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks and what comes after -> a script for each last role that may come before."""
    for batch in batches:
        out = []
        for conv, block, initials, faults, after in zip(*(W.column(batch, c).to_pylist() for c in ("conv", "block", "initials", "faults", "after")), strict=True):
            for begin in range(4):
                found = cheapest(initials, faults, begin, tuple(after))
                if found:
                    out.append((conv, block, found[0] - after[found[2]], found[1], begin, found[2]))
        yield _batch(out, SCRIPTS | {"end": pa.int32()})


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scripts sorted by (conv, block, state) -> those that follow from the start, and the inserts
    behind the last block as a script of its own (block: the largest number)."""
    conv, state, block, taken = None, START, None, True

    def tail() -> list[tuple]:
        return [(conv, (1 << 63) - 1, END[state], "I" * (END[state] // 2), state)] if conv is not None else []

    for batch in batches:
        out = []
        for of, b, cost, script, begin, end in zip(*(W.column(batch, c).to_pylist() for c in (*SCRIPTS, "end")), strict=True):
            if of != conv:
                out += tail()
                conv, state, block = of, START, None
            if b != block:
                block, taken = b, False
            if not taken and begin == state:
                out.append((of, b, cost, script, begin))
                state, taken = end, True
        yield _batch(out, SCRIPTS)
    yield _batch(tail(), SCRIPTS)


def scripts(rows: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(conv, block, cost, script, state) of every block of ``faulty`` rows."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    own = F.shiftright("at", 33)  # the partition a row was sorted in
    dealt = rows.select("conv", "at", "initial", "fault").repartition(parts, "conv", own).sortWithinPartitions("conv", "at")
    schema = "conv string, block long, initials string, faults binary"
    blocks = scratch.put(dealt.mapInArrow(_blocks(block), schema), "blocks")
    counted = blocks.groupBy("conv").agg(F.count("*").alias("blocks"))
    blocks = scratch.put(blocks.join(counted, "conv"), "counted")
    schema = "conv string, block long, cost long, script string, state int"
    one = blocks.where("blocks = 1").mapInArrow(_single, schema)

    many = blocks.where("blocks > 1").repartition(parts, "conv", "block")
    costs = many.mapInArrow(_between, "conv string, block long, costs array<long>")
    ordered = costs.repartition(parts, "conv").sortWithinPartitions("conv", F.col("block").desc())
    after = scratch.put(ordered.mapInArrow(_afters, "conv string, block long, after array<long>"), "after")
    each = many.join(after, ["conv", "block"]).mapInArrow(_scripts, schema + ", end int")
    chained = each.repartition(parts, "conv").sortWithinPartitions("conv", "block", "state").mapInArrow(_chained, schema)
    return scratch.put(one.unionByName(chained), "scripts")


class _Repair:
    """One conversation as it streams by: its script is applied and the digest kept up."""

    def __init__(self, conv: str) -> None:
        self.conv, self.cost, self.audit, self.state = conv, 0, [], START
        self.script, self.digest, self.lines, self.initial, self.illegal = "", hashlib.sha256(), 0, None, 0

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.script.startswith("I"):
            self.script = self.script[1:]
            self.state = NEXT[self.state]
            self.line(ROLES[self.state], "")

    def block(self, cost: int, script: str) -> None:
        self.inserts()
        self.cost += cost
        self.audit.append(script)
        self.script = script

    def row(self, role: str, text: str) -> None:
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.inserts()
        edit, self.script = self.script[:1], self.script[1:]
        if edit == "K":
            self.state = _kept(self.state, role[:1])
            self.line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.line(ROLES[self.state], text)

    def done(self) -> tuple:
        self.inserts()
        return self.conv, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scripts and rows sorted by (conv, at, kind) -> one row a conversation."""
    kinds = {"conv": pa.string(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
    now = None
    for batch in batches:
        out = []
        for conv, kind, role, text, cost, script in zip(*(W.column(batch, c).to_pylist() for c in ("conv", "kind", "role", "text", "cost", "script")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.done())
                now = _Repair(conv)
            if kind == 0:
                now.block(cost, script)
            else:
                now.row(role, text)
        yield _batch(out, kinds)
    if now is not None:
        yield _batch([now.done()], kinds)


def repaired(conversations: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every conv_id of ``conversations``, from its ``rows`` as they are now:
    counts of faults, the cheapest script with its cost, and the digest of what it makes."""
    scratch = Scratch(conversations.sparkSession)
    parts = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = faulty(rows, scratch)
    of = scripts(rows, scratch, block)
    nothing = F.lit(None).cast("string")
    both = rows.select("conv", "at", F.lit(1).alias("kind"), "role", "text", F.lit(0).cast("long").alias("cost"), nothing.alias("script"))
    both = both.unionByName(of.select("conv", F.col("block").alias("at"), F.lit(0).alias("kind"), nothing.alias("role"), nothing.alias("text"), "cost", "script"))
    schema = "conv string, illegal long, cost long, audit string, repaired_sha256 string"
    made = both.repartition(parts, "conv").sortWithinPartitions("conv", "at", "kind").mapInArrow(_repaired, schema)

    count = lambda kind: F.sum((F.col("fault") == kind).cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = rows.groupBy("conv").agg(gaps.alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    ids = conversations.select("conv_id").distinct().withColumn("conv", conv)
    out = ids.join(counts, "conv", "left").join(made, "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))

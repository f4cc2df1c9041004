"""Repair of conversations against a search over all scripts and a plain version of the damage."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import conversations as C

WHITE = " \t\n\x0b\f\r"
ORDER = {"": 0, "s": 1, "u": 2, "a": 3}


def best(initials, faults):
    """(cost, script) by dynamic programming over prefixes: the least pair for each last role."""
    nexts = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(found):
        for _ in range(3):
            for s, (c, a) in list(found.items()):
                found[nexts[s]] = min(found.get(nexts[s], (c + 2, a + "I")), (c + 2, a + "I"))
        return found

    found = {0: (0, "")}
    for x, fault in zip(initials, faults, strict=True):
        now = {}
        for s, (c, a) in inserted(found).items():
            steps = [(s, c + 3, "D")]
            if fault not in (C.BLANK, C.DUPLICATE):
                more = int(fault == C.TRUNCATED)
                steps.append((nexts[s], c + 2 + more, "R"))
                if (x == "s" and s == 0) or (x == "u" and s != 2) or (x == "a" and s == 2):
                    steps.append((ORDER[x], c + more, "K"))
            for to, cost, edit in steps:
                now[to] = min(now.get(to, (cost, a + edit)), (cost, a + edit))
        found = now
    return min(v for s, v in inserted(found).items() if s in (0, 3))


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_script(seed):
    rng = random.Random(seed)
    for _ in range(800):
        n = rng.randrange(13)
        initials, faults = "".join(rng.choice("suuaa-") for _ in range(n)), bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert C.cheapest(initials, faults)[:2] == best(initials, faults)


def plain(rows):
    """(conv_id, turn, role, text) rows -> the contract's columns, in plain Python."""
    made = {}
    for conv, turn, role, text in rows:
        made.setdefault(conv, [])
        rule = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if rule == 0:
            continue
        text = "" if rule == 1 else "".join(c for c in text if c not in ".!?") if rule == 2 else text
        made[conv] += [(turn, "user" if rule == 4 else role, text)] * (2 if rule == 3 else 1)
    out = []
    for conv, own in made.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.rstrip(WHITE)
            faults.append(C.BLANK if not bare else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if bare[-1] not in ".!?" else C.NONE)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = best([x if x in "sua" and x else "-" for x in initials], faults)
        lines, k, last = [], 0, 0
        for edit in audit:
            if edit == "I":
                last = 3 if last == 2 else 2
                lines.append(("assistant" if last == 3 else "user") + ":")
                continue
            _, role, text = own[k]
            k += 1
            if edit == "R":
                last = 3 if last == 2 else 2
                lines.append(("assistant:" if last == 3 else "user:") + text)
            elif edit == "K":
                last = ORDER[role[:1]]
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x + y not in ("su", "ua", "au") or not x for x, y in zip(initials, initials[1:]))
        out.append((conv, gaps, faults.count(C.BLANK), faults.count(C.DUPLICATE), faults.count(C.TRUNCATED), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "sage", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "Why? ", "é…", "half a", "", " \n", "ok.\t\x0b", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 5, None]), role, text))
    rows += [(100, k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else "user", f"Line {k % 90}." if rng.random() < 0.95 else "") for k in range(700)]
    rows += [(200, None, None, None)] * 3 + [(201, 5, "user", "Hi.")] * 4
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3), (3, 1)])
def test_equal_to_the_plain_version(spark, seed, block):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("clash")).repartition(6)
    got = C.repaired(df, C.damaged(df), block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_conversations_of_strings_and_none(spark):
    rows = [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", 1, "user", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    assert sorted((tuple(r) for r in C.repaired(df, C.damaged(df)).collect()), key=str) == plain(rows)
    assert C.repaired(df.limit(0), C.damaged(df.limit(0))).collect() == []

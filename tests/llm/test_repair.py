"""Conversation repair against a plain dynamic programme, on odd rows and over many tasks."""

import hashlib
import random
import re
from binascii import crc32
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from casebook.llm import repair

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("audit", T.StringType()), T.StructField("cost", T.LongType()),
])


def brute(rows, entry=0, ends=(0, 3)):
    """The least (cost, audit): all edits, up to three turns inserted at every place."""
    states = {entry: (0, "")}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for p, (c, a) in list(out.items()):
                q, way = 3 if p == 2 else 2, (c + 2, a + "I")
                out[q] = min(way, out.get(q, way))
        return out

    for code in rows:
        kind, fault = divmod(code, 3)
        new = {}
        for p, (c, a) in inserted(states).items():
            ways = [(p, (c + 3, a + "D"))]
            if fault < 2:
                if kind == 0 and p == 0 or kind == 1 and p != 2 or kind == 2 and p == 2:
                    ways.append((kind + 1, (c + fault, a + "K")))
                ways.append((3 if p == 2 else 2, (c + fault + 2, a + "R")))
            for q, way in ways:
                new[q] = min(way, new.get(q, way))
        states = new
    return min((w for p, w in inserted(states).items() if p in ends), default=None)


def test_search_equals_a_dynamic_programme():
    rng = random.Random(11)
    for _ in range(2000):
        rows = bytes(rng.randrange(12) for _ in range(rng.randint(0, 12)))
        assert repair.solve(rows) == brute(rows)
        entry, ends = rng.randrange(4), (rng.randrange(4),)
        assert repair.solve(rows, entry, ends) == brute(rows, entry, ends)


def test_joined_segments_equal_one_search(monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 5)
    rng = random.Random(12)
    for _ in range(200):
        rows = bytes(rng.randrange(12) for _ in range(rng.randint(0, 60)))
        assert repair.cheapest(rows) == brute(rows)


def expected(turns, damaged=True):
    """Every conversation in plain Python; turns are (conv, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        own = groups[conv]
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = crc32(key.encode()) % 20 if damaged else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, counts = set(), [], [0, 0, 0, 0]
        for place, (turn, role, text) in enumerate(rows):
            bare = text.strip(" \t\n\v\f\r")
            fault = 0
            if not bare:
                counts[0], fault = counts[0] + 1, 2
            elif (role, text) in seen:
                counts[1], fault = counts[1] + 1, 2
            elif bare[-1] not in ".!?":
                counts[2], fault = counts[2] + 1, 1
            seen.add((role, text))
            if place:
                counts[3] += rows[place - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            codes.append(3 * {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + fault)
        known = {r[0] for r in rows if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        cost, audit = brute(codes)
        lines, at, last = [], 0, "a"
        for letter in audit:
            role, text = rows[at][1:] if letter != "I" else (None, "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if last == "u" else "user"
            lines.append(f"{role}:{text}")
            last = role[0]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, cost, audit, digest)
    return out


def found(frame):
    return {r["conv_id"]: tuple(r[c] for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    )) for r in frame.collect()}


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"),
    (1, None, "user", "No turn."), (2, 5, None, None), (2, 9, "tool", "x"), (2, 9, "user", "y"),
    (3, 0, "", "empty role."), (3, 1, "assistant", ""), (None, 0, "user", "a" * 300_000),
    (None, None, None, None), (None, 1, "assistant", "ok."), (4, 0, "system", "be good."),
    (4, 1, "system", "be bad."), (5, 0, "assistant", " "), (6, 0, "user", "gap."),
    (6, 4, "assistant", "gap?"), (7, -3, "user", "é"), (7, 2, "user", "中。"),
]


@pytest.mark.parametrize("damaged", [True, False])
def test_odd_conversations(spark, damaged):
    rows = spark.createDataFrame([(*r, "x", 1) for r in ODD], SCHEMA)
    turns = repair.damage(rows) if damaged else repair.as_turns(rows)
    assert found(repair.audited(turns)) == expected(ODD, damaged)


def test_empty_table(spark):
    assert repair.audited(repair.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_all_turns_dropped(spark):
    dropped = [c for c in range(400) if crc32(f"{c}:0".encode()) % 20 == 0][:2]
    turns = [(c, 0, "user", "x.") for c in dropped]
    rows = spark.createDataFrame([(*r, "x", 1) for r in turns], SCHEMA)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(repair.audited(repair.damage(rows))) == dict.fromkeys(dropped, nothing)


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    """A conversation of most rows is dealt over tasks and joined again."""
    rng = random.Random(13)
    turns = [
        (7, rng.randrange(4000), rng.choice(["user", "assistant", "assistant", "user", "system"]),
         rng.choice(["Yes.", "no", "", f"text {rng.random()}!"])) for _ in range(1500)
    ] + [(c, t, "user", f"{c}.") for c in range(20) for t in range(3)]
    rows = spark.createDataFrame([(*r, "x", 1) for r in turns], SCHEMA)
    damaged = repair.damage(rows)
    order = ["conv_id", "turn", "role", "digest"]
    parts = repair.faults(damaged).repartitionByRange(6, *order).rdd.glom().map(
        lambda p: sum(r["conv_id"] == 7 for r in p)).collect()
    assert max(parts) < 700
    assert found(repair.audited(damaged)) == expected(turns)

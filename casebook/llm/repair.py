"""Conversation structure: faults of the turns and the cheapest edits that mend their order of roles.

A repaired conversation has the role initials ``(s?(ua)+)?``. Edits, in the order of the turns:
Keep (0), Rerole to user or assistant (2), Delete (3, forced for blank and repeated turns) and
Insert of an empty user or assistant turn anywhere (2); a truncated turn that stays adds 1. Of the
cheapest edits the ones whose initials are ASCII-least win.

The search is depth-first branch and bound (:func:`solve`): an explicit stack, a lower bound of
every suffix, the best (cost, audit) so far, and a table of the best prefix at every (turn, phase).
Turns meet it as one byte each: a range sort deals them, so a conversation of any length is spread
over many tasks; a task solves its stretch in segments for every pair of phases, and the stretches
of a conversation that spans tasks are joined end to end. Texts are moved once, to be written
out by the audit (:func:`repaired_turns`); this step and the digest of one conversation are a
stream in one task, whose memory holds one batch and the audit, which is one letter a turn.

Null role and text are one space, in damage keys null ids and turns too. Turns are ordered by turn
(nulls first), ties by role, then by the md5 of the text; rows that repeat whole are duplicates.
A null conversation id is one conversation. A role without an initial can't be kept. An empty table
gives no rows. A very long text costs its task its own size a few times over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from casebook.sources.staging import stage

SEGMENT = 32
# Phases: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (START, ASSISTANT)
_CLASSES = {"s": 0, "u": 1, "a": 2}
_PHASE = {0: SYSTEM, 1: USER, 2: ASSISTANT}
SPACE = r"\x20\x09-\x0D"


# --- the search ---------------------------------------------------------------------------------


def _fits(phase: int, kind: int) -> bool:
    """Whether a turn of this class may follow."""
    if kind == 0:
        return phase == START
    if kind == 1:
        return phase != USER
    return kind == 2 and phase == USER


def _suffixes(rows: bytes, ends: tuple[int, ...]) -> tuple[list[int], list[int], list[int | None]]:
    """Per place: unavoidable cost, illegal neighbours, and class of the next turn that may stay.

    Every edit beyond the unavoidable cost takes at least 2 and mends at most two illegal pairs.
    """
    base, pairs, heads = [0], [0], [None]
    for code in reversed(rows):
        kind, fault = divmod(code, 3)
        if fault == 2:
            base.append(base[-1] + 3), pairs.append(pairs[-1]), heads.append(heads[-1])
            continue
        phase = _PHASE.get(kind)
        if phase is None:
            bad = True
        elif heads[-1] is None:
            bad = phase not in ends
        else:
            bad = not _fits(phase, heads[-1])
        base.append(base[-1] + fault), pairs.append(pairs[-1] + bad), heads.append(kind)
    return base[::-1], pairs[::-1], heads[::-1]


@lru_cache(maxsize=20_000)
def solve(rows: bytes, entry: int = START, ends: tuple[int, ...] = _ENDS) -> tuple[int, str] | None:
    """The least ``(cost, audit)`` that takes ``rows`` from phase ``entry`` to one of ``ends``.

    A row is ``3 * class + fault``: class 0 system, 1 user, 2 assistant, 3 other; fault 0 none,
    1 truncated, 2 must go. None if no edits lead there.
    """
    base, pairs, heads = _suffixes(rows, ends)
    n = len(rows)

    def bound(i: int, phase: int) -> int:
        head = heads[i]
        bad = pairs[i] + (phase not in ends if head is None else not _fits(phase, head))
        return base[i] + (bad + 1) // 2 * 2

    best: tuple[int, str] | None = None
    table = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, phase, cost, audit = stack.pop()
        if table[i, phase] != (cost, audit):
            continue  # a better prefix has come by since
        if i == n and phase in ends and (best is None or (cost, audit) < best):
            best = cost, audit
        children = []
        if phase == USER:
            children.append((i, ASSISTANT, cost + 2, "I"))
        else:
            children.append((i, USER, cost + 2, "I"))
        if i < n:
            kind, fault = divmod(rows[i], 3)
            children.append((i + 1, phase, cost + 3, "D"))
            if fault < 2:
                if _fits(phase, kind):
                    children.append((i + 1, _PHASE[kind], cost + fault, "K"))
                to = ASSISTANT if phase == USER else USER
                if _PHASE.get(kind) != to:
                    children.append((i + 1, to, cost + fault + 2, "R"))
        ranked = []
        for j, after, price, letter in children:
            least, mine = price + bound(j, after), audit + letter
            if best is not None and (
                least > best[0] or least == best[0] and mine > best[1][: len(mine)]
            ):
                continue
            known = table.get((j, after))
            if known is not None and known <= (price, mine):
                continue
            table[j, after] = price, mine
            ranked.append((least, mine, j, after, price))
        for least, mine, j, after, price in sorted(ranked, reverse=True):
            stack.append((j, after, price, mine))
    return best


Way = tuple[int, str] | None
#: The best way from each phase to each phase, or None where there is none.
Matrix = list[list[Way]]


def _joined(a: Matrix, b: Matrix) -> Matrix:
    """The best ways through both stretches: equal costs into one phase mean equal lengths or
    audits that part before either ends, so the least prefix stays the least."""
    out: Matrix = [[None] * 4 for _ in a]
    for p, row in enumerate(a):
        for m, first in enumerate(row):
            if first is None:
                continue
            for q, second in enumerate(b[m]):
                if second is not None:
                    way = first[0] + second[0], first[1] + second[1]
                    if out[p][q] is None or way < out[p][q]:
                        out[p][q] = way
    return out


def _ways(rows: bytes) -> Matrix:
    """Segments solved on their own and joined in pairs, so no audit is copied often."""
    parts = [
        [[solve(rows[at:at + SEGMENT], p, (q,)) for q in range(4)] for p in range(4)]
        for at in range(0, max(1, len(rows)), SEGMENT)
    ]
    while len(parts) > 1:
        pairs = [_joined(a, b) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(pairs) * 2:]
    return parts[0]


def _end(ways: list[Way]) -> tuple[int, str]:
    return min(w for w in (ways[e] for e in _ENDS) if w is not None)


def cheapest(rows: bytes) -> tuple[int, str]:
    """The cheapest edits of a whole conversation."""
    if len(rows) <= SEGMENT:
        return solve(rows)
    return _end(_ways(rows)[START])


# --- faults of the turns ------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """Turns with reproducible faults by ``crc32("conv_id:turn") % 20``; see the module's nulls.

    0 drops the turn (``copies`` 0), 1 empties its text, 2 removes its ``.!?``, 3 repeats it
    (``copies`` 2), 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def as_turns(turns: DataFrame) -> DataFrame:
    """Turns as they are, in the columns that :func:`repairs` reads."""
    return turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def faults(turns: DataFrame) -> DataFrame:
    """One row for each (conversation, turn, role, digest): how many there are and their faults.

    Equal turns are counted before they are shuffled, and no text is.
    """
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = turns.select(
        "conv_id", "turn", "role", F.md5("text").alias("digest"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"),
        F.col("text").rlike(rf"[^.!?{SPACE}][{SPACE}]*\z").alias("open"),
        "copies",
    ).groupBy("conv_id", "turn", "role", "digest", "blank", "open").agg(
        F.sum("copies").alias("copies"))
    seen = rows.where("copies > 0 and not blank").groupBy(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"),
        F.col("digest").alias("_digest"),
    ).agg(F.min(place).alias("_first"))
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest")))
    return rows.join(seen, same, "left").select(
        "conv_id", "turn", "role", "digest", "copies", "blank", "open",
        (~F.col("blank") & F.coalesce(place > F.col("_first"), F.lit(False))).alias("again"),
    )


# --- conversations ------------------------------------------------------------------------------

_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_LEGAL = {"su", "ua", "au"}


class _Stretch:
    """The turns of one conversation that a task holds."""

    def __init__(self, conv):
        self.conv, self.rows = conv, bytearray()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None  # initials
        self.low = self.high = None
        self.distinct = 0

    def add(self, turn, role, copies, blank, open_, again) -> None:
        if copies == 0:
            return
        initial = role[:1]
        kind = _CLASSES.get(initial, 3)
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.distinct += turn != self.high
            self.high = turn
        if self.last is not None:
            self.counts["illegal"] += self.last + initial not in _LEGAL
        self.counts["illegal"] += copies - 1
        self.first = initial if self.first is None else self.first
        self.last = initial
        fault = 2 if blank or again else int(open_)
        self.rows.append(3 * kind + fault)
        self.rows.extend(bytes([3 * kind + 2]) * (copies - 1))
        if blank:
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies - 1 + again
            self.counts["truncated"] += not again and open_


_REPAIR = T.StructType([
    T.StructField("gaps", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in _COUNTS],
    T.StructField("cost", T.LongType()),
    T.StructField("audit", T.StringType()),
])
_OPEN = T.StructType([
    T.StructField("part", T.LongType()),
    *[T.StructField(c, T.LongType()) for c in _COUNTS],
    T.StructField("first", T.StringType()),
    T.StructField("last", T.StringType()),
    T.StructField("low", T.LongType()),
    T.StructField("high", T.LongType()),
    T.StructField("distinct", T.LongType()),
    T.StructField("costs", T.ArrayType(T.LongType())),
    T.StructField("audits", T.ArrayType(T.StringType())),
])


def _gaps(low, high, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def _closed(s: _Stretch) -> dict:
    cost, audit = cheapest(bytes(s.rows))
    return {"gaps": _gaps(s.low, s.high, s.distinct), **s.counts, "cost": cost, "audit": audit}


def _opened(s: _Stretch, part: int) -> dict:
    cells = [w for row in _ways(bytes(s.rows)) for w in row]
    return {
        "part": part, **s.counts, "first": s.first, "last": s.last, "low": s.low, "high": s.high,
        "distinct": s.distinct, "costs": [w and w[0] for w in cells],
        "audits": [w and w[1] for w in cells],
    }


def _arrow(conv_type: T.DataType) -> pa.Schema:
    return to_arrow_schema(_searched_schema(conv_type))


def _searched_schema(conv_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("whole", _REPAIR),
        T.StructField("stretch", _OPEN),
    ])


def _searcher(conv_type: T.DataType):
    """Sorted turns to conversations; the first and last of a task may go on in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, part = _arrow(conv_type), TaskContext.get().partitionId()
        current, opening, out = None, True, []

        def flush():
            nonlocal out
            batch, out = pa.RecordBatch.from_pylist(out, schema), []
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (
                "conv_id", "turn", "role", "copies", "blank", "open", "again")]
            for conv, *row in zip(*columns):
                if current is None:
                    current = _Stretch(conv)
                elif current.conv != conv:
                    if opening:
                        out.append({"conv_id": current.conv, "stretch": _opened(current, part)})
                        opening = False
                    else:
                        out.append({"conv_id": current.conv, "whole": _closed(current)})
                    current = _Stretch(conv)
                current.add(*row)
            yield flush()
        if current is not None:
            out.append({"conv_id": current.conv, "stretch": _opened(current, part)})
            yield flush()

    return run


class _Chain:
    """Stretches of one conversation, joined in order."""

    def __init__(self, conv):
        self.conv, self.counts = conv, dict.fromkeys(_COUNTS, 0)
        self.last = self.low = self.high = None
        self.distinct = 0
        self.ways: list[Way] = [(0, ""), None, None, None]

    def add(self, s: dict) -> None:
        for c in _COUNTS:
            self.counts[c] += s[c]
        if s["first"] is not None:
            if self.last is not None:
                self.counts["illegal"] += self.last + s["first"] not in _LEGAL
            self.last = s["last"]
        if s["low"] is not None:
            self.distinct += s["distinct"] - (s["low"] == self.high)
            self.low = s["low"] if self.low is None else self.low
            self.high = s["high"]
        cells = [c if c is None else (c, a) for c, a in zip(s["costs"], s["audits"])]
        self.ways = _joined([self.ways], [cells[4 * p:4 * p + 4] for p in range(4)])[0]

    def row(self) -> dict:
        cost, audit = _end(self.ways)
        return {"conv_id": self.conv, "whole": {
            "gaps": _gaps(self.low, self.high, self.distinct), **self.counts, "cost": cost,
            "audit": audit}}


def _joiner(conv_type: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, chain = _arrow(conv_type), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if chain is None or chain.conv != row["conv_id"]:
                    if chain is not None:
                        out.append(chain.row())
                    chain = _Chain(row["conv_id"])
                chain.add(row["stretch"])
            yield pa.RecordBatch.from_pylist(out, schema)
        if chain is not None:
            yield pa.RecordBatch.from_pylist([chain.row()], schema)

    return run


def repairs(turns: DataFrame) -> DataFrame:
    """One row a conversation: faults, and the cheapest edits as ``cost`` and ``audit``.

    ``turns`` comes from :func:`damage` or :func:`as_turns`. Conversations whose turns are all
    dropped have zeros and an empty audit.
    """
    conv_type = turns.schema["conv_id"].dataType
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    dealt = faults(turns).withColumns({"turn": F.col("turn").cast("long")}).orderBy(*order)
    schema = _searched_schema(conv_type)
    found = stage(dealt.mapInArrow(_searcher(conv_type), schema), "repairs")
    stretches = found.where("stretch is not null").repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "stretch.part")
    joined = stretches.mapInArrow(_joiner(conv_type), schema)
    whole = found.where("whole is not null").unionByName(joined)
    return whole.select("conv_id", "whole.*")


# --- repaired texts -----------------------------------------------------------------------------


def repaired_turns(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)`` of every turn that stays or comes in.

    The turns of a conversation follow each other in one partition, in order.
    """
    conv_type = turns.schema["conv_id"].dataType
    schema = T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("place", T.LongType()),
        T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ])
    rows = turns.where("copies > 0").select(
        "conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text",
        F.md5("text").alias("digest"), "copies", F.lit(None).cast("string").alias("audit"))
    plans = repaired.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("digest"), F.lit(0).alias("copies"), "audit")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "digest")]
    dealt = plans.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        conv, audit, at, phase, place, out = None, "", 0, START, 0, []

        def put(edit, role, text):
            nonlocal phase, place
            out.append({
                "conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
            phase, place = _PHASE[_CLASSES[role[:1]]], place + 1

        def role_next():
            return "assistant" if phase == USER else "user"

        def inserts():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", role_next(), "")
                at += 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (
                "conv_id", "kind", "role", "text", "copies", "audit")]
            for own, kind, role, text, copies, plan in zip(*columns):
                if kind == 0:
                    inserts()
                    conv, audit, at, phase, place = own, plan, 0, START, 0
                for _ in range(copies):
                    inserts()
                    letter, at = audit[at], at + 1
                    if letter == "K":
                        put("K", role, text)
                    elif letter == "R":
                        put("R", role_next(), text)
            yield pa.RecordBatch.from_pylist(out, out_schema)
            out = []
        inserts()
        yield pa.RecordBatch.from_pylist(out, out_schema)

    return dealt.mapInArrow(run, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of the lines ``role:text`` of :func:`repaired_turns`."""
    schema = T.StructType([
        repaired.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema, conv, digest, out = to_arrow_schema(schema), None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")]
            for own, place, role, text in zip(*columns):
                if place == 0:
                    if digest is not None:
                        out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(out, out_schema)
            out = []
        if digest is not None:
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], out_schema)

    return repaired.mapInArrow(run, schema)


def audited(turns: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the digest of the repaired turns of every conversation."""
    found = stage(repairs(turns), "audits")
    own = digests(repaired_turns(turns, found)).withColumnRenamed("conv_id", "_conv")
    joined = found.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(
        *found.columns,
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

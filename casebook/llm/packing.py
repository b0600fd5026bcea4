"""Packing of token ids into windows of near-equal fill by Karmarkar-Karp multiway differencing.

A document's ids end with a separator id. Ids beyond full windows are cut off as full windows;
what is left over is gathered into groups and each group is differenced into as many windows as
its ids need. If the fullest window exceeds the capacity, the group gets one window more.

Packing runs in the tasks that read the documents, without a shuffle. Null and empty texts are
the separator alone. Repeated rows are packed as often as they occur; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from casebook.llm.encoder import packed_ids, release, tokenizer_path
from casebook.llm.memory import tidy

CAPACITY = 4096
SEPARATOR = 2
GROUP_WINDOWS = 64
SLACK = 0.01
ROWS_PER_BATCH = 2_000

PIECES = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
])


def difference(sizes: Sequence[int], ways: int) -> list[list[int]]:
    """Split item numbers into ``ways`` parts of near-equal total size.

    A partial partition is its part totals in falling order. The two partitions with the largest
    spread merge, the largest part of one with the smallest of the other, until one is left.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    queue = []
    for item, size in enumerate(sizes):
        # Parts that hold nothing yet stay implicit: only the filled ones are listed.
        queue.append((-size, item, [(size, [item])]))
    heapq.heapify(queue)
    ticket = len(queue)
    while len(queue) > 1:
        _, _, first = heapq.heappop(queue)
        _, _, second = heapq.heappop(queue)
        overlap = len(first) + len(second) - ways
        if overlap <= 0:
            merged = first + second
        else:
            kept = len(first) - overlap
            merged = first[:kept] + [
                (a[0] + b[0], a[1] + b[1])
                for a, b in zip(first[kept:], reversed(second[len(second) - overlap:]))
            ] + second[: len(second) - overlap]
        merged.sort(key=lambda part: -part[0])
        low = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(queue, (low - merged[0][0], ticket, merged))
        ticket += 1
    parts = [items for _, items in queue[0][2]]
    return parts + [[] for _ in range(ways - len(parts))]


def windows(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Differenced windows within ``capacity``; their number rises until the fullest fits."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, ways)
        if max(sum(sizes[i] for i in part) for part in parts) <= capacity:
            return [sorted(part) for part in parts if part]
        ways += 1


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, separator: int):
    end = separator.to_bytes(4, "little")
    sequence = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    rest: list[tuple[int | None, int, bytes, int]] = []
    held = 0

    def piece(doc, start, ids, total, place):
        rows.append((doc, start, len(ids) // 4, ids, zlib.crc32(ids), total, sequence, place))

    def close():
        nonlocal sequence, held
        for part in windows([len(r[2]) // 4 for r in rest], capacity):
            place = 0
            for item in part:
                doc, start, ids, total = rest[item]
                piece(doc, start, ids, total, place)
                place += len(ids) // 4
            sequence += 1
        rest.clear()
        held = 0

    def batch():
        columns = list(zip(*rows))
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW
        )
        rows.clear()
        return out

    width = capacity * 4
    full = int(GROUP_WINDOWS * capacity * (1 - SLACK))
    for incoming in batches:
        for doc, text in zip(incoming.column(0).to_pylist(), incoming.column(1)):
            ids = packed_ids(text.as_py(), path) + end
            total, start = len(ids) // 4, 0
            while len(ids) - start >= width:
                piece(doc, start // 4, ids[start:start + width], total, 0)
                sequence += 1
                start += width
            left = ids[start:]
            # A group is cut where its ids fill whole windows but for a small slack.
            room = full - held
            if len(left) // 4 > room:
                if room:
                    rest.append((doc, start // 4, left[: room * 4], total))
                close()
                start, left = start + room * 4, left[room * 4:]
            if left:
                rest.append((doc, start // 4, left, total))
                held += len(left) // 4
            if len(rows) >= ROWS_PER_BATCH:
                yield batch()
    if rest:
        close()
    if rows:
        yield batch()


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    separator: int = SEPARATOR,
) -> DataFrame:
    """The pieces of all documents with their ids, sequence and place in it."""
    path = tokenizer or tokenizer_path()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(lambda batches: _packed(batches, path, capacity, separator), release), PIECES
    )

"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

A word's score is ``count(gram) / count(context)`` for the longest gram ending in it that occurs in
another document, times 0.4 for each word the context had to be shortened by; without any, the
word's share of all words; a word that no other document has counts half. Counts leave the scored
document out. Grams do not cross documents.

Segments of whole documents are written with their words as numbers of a local vocabulary. Each
segment sends the distinct grams it holds, with its own counts, to the count tables, which are
partitioned by hash; a table partition adds up what all segments sent and answers each of them
with what the other segments hold of its grams; where they hold none of a stretch, it sends nothing.
A gram is one entry per segment however often it occurs, so frequent grams make no large group.
Segments then look their documents' grams up and sum by document. Each length of gram is counted
on its own and its answers are staged, so the grams of one length at most lie shuffled on disk.

Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z folded. Words are told apart by 48-bit
hashes, longer grams by 64-bit ones, of which the tables compare 48 bits and the partition. Null
and blank texts have no words and score 0. Repeated rows each count as documents of their own. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebook.llm import wordhash
from casebook.llm.memory import tidy
from casebook.sources.staging import stage

#: The longest gram of the registered query.
ORDER = 3
BACKOFF = 0.4
SEGMENT_BYTES = 2 << 20
TABLE_ENTRIES = 1_000_000

WORD = wordhash.byte_class((0x20, 0x20), (0x09, 0x0D))
_PLACE = wordhash._numbers(16, 5) | np.uint64(1)

_SEGMENT = pa.schema([
    ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
    ("total", pa.int64()), ("vocabulary", pa.binary()), ("words", pa.binary()),
])


_LOW = np.uint64((1 << 48) - 1)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte place by byte place."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(planes).view("<u4")[:, 0].astype(np.int64)


def _low_bytes(hashes: np.ndarray) -> bytes:
    """The six low bytes of each 64-bit hash."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_low_bytes(data: bytes) -> np.ndarray:
    low = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :6] = low
    return wide.view(np.uint64)[:, 0]


def _segments(batches: Iterator[pa.RecordBatch]):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        blocks = wordhash.blocks(batch.column(1), WORD, SEGMENT_BYTES)
        for first, end, hashes, counts in blocks:
            vocabulary, words = np.unique(hashes & _LOW, return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "segment": [number],
                "doc_ids": [batch.column(0).slice(first, end - first).to_pylist()],
                "n_words": [counts.tolist()],
                "total": [len(hashes)],
                "vocabulary": [_low_bytes(vocabulary)],
                "words": [_packed(words)],
            }, schema=_SEGMENT)
            number += 1


def grams(hashes: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the gram that ends at each place, and where the document is long enough."""
    row_start = np.repeat(np.cumsum(counts) - counts, counts)
    inside = np.arange(len(hashes)) - row_start >= order - 1
    if order == 1:
        return hashes, inside
    total = np.zeros(len(hashes), np.uint64)
    for back in range(order):
        if back < len(hashes):
            total[back:] += hashes[:len(hashes) - back] * _PLACE[back]
    return wordhash.mixed(total + _PLACE[15] * np.uint64(order)), inside


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    # Mixed again, so that the tables split words evenly by their high bits.
    vocabulary = wordhash.mixed(_from_low_bytes(row["vocabulary"]))
    return vocabulary[_unpacked(row["words"])], np.array(row["n_words"], np.int64)


def _distinct(hashes: np.ndarray, counts: np.ndarray, order: int):
    found, inside = grams(hashes, counts, order)
    return np.unique(found[inside], return_counts=True)


def _table_of(values: np.ndarray, tables: int) -> np.ndarray:
    """The ends of each table's stretch of ascending values."""
    bars = [(i << 64) // tables for i in range(1, tables)]
    return np.searchsorted(values, np.array(bars, np.uint64))


def _entries(batches: Iterator[pa.RecordBatch], order: int, tables: int):
    """The grams of one length."""
    for batch in batches:
        for row in batch.to_pylist():
            hashes, counts = _opened(row)
            values, own = _distinct(hashes, counts, order)
            ends = [0, *_table_of(values, tables).tolist(), len(values)]
            used = [t for t in range(tables) if ends[t + 1] > ends[t]]
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([row["segment"]] * len(used), pa.int64()),
                "order": pa.array([order] * len(used), pa.int32()),
                "table": pa.array(used, pa.int32()),
                "grams": pa.array(
                    [_low_bytes(values[ends[t]:ends[t + 1]]) for t in used], pa.binary()),
                "counts": pa.array([_packed(own[ends[t]:ends[t + 1]]) for t in used], pa.binary()),
            })


def _totals(table: pa.Table) -> pa.Table:
    sizes, values, counts = [], [], []
    for packed, own in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist()):
        values.append(_from_low_bytes(packed))
        counts.append(_unpacked(own))
        sizes.append(len(values[-1]))
    _, place = np.unique(np.concatenate(values), return_inverse=True)
    own = np.concatenate(counts)
    elsewhere = np.bincount(place, weights=own)[place] - own
    ends = np.cumsum(sizes)
    used = [i for i, (s, e) in enumerate(zip(sizes, ends)) if elsewhere[e - s:e].any()]
    return pa.table({
        **{name: table.column(name).take(pa.array(used, pa.int64()))
           for name in ("segment", "order", "table")},
        "elsewhere": pa.array(
            [_packed(elsewhere[ends[i] - sizes[i]:ends[i]]) for i in used], pa.binary()),
    })


def _scores(row: dict, answers: list[dict], order: int, everything: int, tables: int):
    hashes, counts = _opened(row)
    rows = np.repeat(np.arange(len(counts)), counts)
    others = np.zeros((order + 1, len(hashes)))  # by length of the gram: count in other documents
    others[0] = everything - counts[rows]
    for k in range(1, order + 1):
        found, inside = grams(hashes, counts, k)
        values, place, totals = np.unique(
            found[inside], return_inverse=True, return_counts=True)
        if not len(values):
            continue
        ends = [0, *_table_of(values, tables).tolist(), len(values)]
        for answer in answers:
            if answer["order"] == k:
                t = answer["table"]
                totals[ends[t]:ends[t + 1]] += _unpacked(answer["elsewhere"])
        _, mine, own = np.unique(
            rows[inside] * len(values) + place, return_inverse=True, return_counts=True)
        others[k, inside] = totals[place] - own[mine]
    score = np.log(np.maximum(others[1], 0.5) / np.maximum(others[0], 1))
    level = np.ones(len(hashes), np.int64)
    reach = np.minimum(np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts) + 1, order)
    for k in range(2, order + 1):
        context = np.concatenate([[0], others[k - 1][:-1]])
        seen = others[k] > 0
        score[seen] = np.log(others[k][seen] / context[seen])
        level[seen] = k
    score += np.log(BACKOFF) * (reach - level)
    size = len(counts)
    return {
        "doc_id": pa.array(row["doc_ids"], pa.int64()),
        "n_words": pa.array(counts, pa.int64()),
        "n_backed_off": pa.array(np.bincount(rows[level < reach], minlength=size), pa.int64()),
        "n_unseen": pa.array(np.bincount(rows[others[1] == 0], minlength=size), pa.int64()),
        "log_score": pa.array(np.bincount(rows, weights=score, minlength=size), pa.float64()),
    }


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """``(doc_id, n_words, n_backed_off, n_unseen, log_score)`` for every row of ``docs``.

    ``order`` is the longest gram; the registered query takes :data:`ORDER`.
    """
    segments = stage(
        docs.select("doc_id", "text").mapInArrow(
            tidy(_segments),
            "segment long, doc_ids array<long>, n_words array<long>, total long, "
            "vocabulary binary, words binary",
        ),
        "segments",
    )
    everything = segments.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    tables = max(12, everything // TABLE_ENTRIES)
    answers = None
    for k in range(1, order + 1):
        entries = segments.mapInArrow(
            tidy(lambda b, k=k: _entries(b, k, tables)),
            "segment long, order int, table int, grams binary, counts binary",
        )
        found = stage(entries.groupBy("table").applyInArrow(
            _totals, "segment long, order int, table int, elsewhere binary"), "answers")
        answers = found if answers is None else answers.unionByName(found)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(_scores(left.to_pylist()[0], right.to_pylist(), order, everything, tables))

    return segments.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(
        scored, "doc_id long, n_words long, n_backed_off long, n_unseen long, log_score double")

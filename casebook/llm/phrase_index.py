"""A positional inverted index over whole documents, searched for phrases.

The index is split by document: a segment holds the documents of one stretch of a scan, and for
every term the ascending places where it stands. Places count on through a segment with a gap
between documents, so no phrase can run over from one into the next. A phrase is found by taking
the list of its rarest term in the segment, shifted to the phrase's start, and intersecting it
with the shifted lists of the other terms, rarest first. Index and search need no shuffle; the
places of a term that holds a third of all words stay in their segments.

Words are runs of ``[0-9a-z]`` and of characters from U+0080 on, after folding A-Z. Null and empty
texts have no words and no matches. Terms are 64-bit word hashes. Items without words are never
found; an item id counts once for a document, however many rows of the benchmark bear it. Repeated
rows of documents each count. Duplicate and null document ids do no harm: rows are
told apart by segment and place. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casebook.llm import wordhash
from casebook.llm.memory import tidy
from casebook.sources.staging import stage

WINDOW = 13
CONTAMINATED = 20  # a document is contaminated when one word in twenty, or more, is hit
ITEMS_PER_BLOCK = 20_000
TERMS_KEPT = 2_000_000

WORD = wordhash.byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

SEGMENT = (
    "segment long, doc_ids array<long>, n_words array<long>, terms binary, sizes binary, "
    "places binary"
)
HITS = "segment long, row int, doc_id long, n_words long, hits array<int>, items array<string>"


def _members(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


def _segments(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None):
    """Segments of about two megabytes of text, or one longer document."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    flags = None
    if wanted is not None:
        flags = np.zeros(1 << 20, bool)
        flags[(wanted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    for batch in batches:
        ids = batch.column(0)
        for first, end, hashes, counts in wordhash.blocks(batch.column(1), WORD):
            starts = np.cumsum(counts + 1) - (counts + 1)
            places = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
            if flags is not None:
                near = np.flatnonzero(flags[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
                near = near[_members(wanted, hashes[near])]
                hashes, places = hashes[near], places[near]
            order = np.argsort(hashes, kind="stable")
            terms, sizes = np.unique(hashes[order], return_counts=True)
            assert len(starts) == end - first
            yield pa.RecordBatch.from_pydict({
                "segment": [number],
                "doc_ids": [ids.slice(first, end - first).to_pylist()],
                "n_words": [counts.tolist()],
                "terms": [terms.tobytes()],
                "sizes": [sizes.astype(np.uint32).tobytes()],
                "places": [places[order].astype(np.uint32).tobytes()],
            }, schema=_SEGMENT)
            number += 1


_SEGMENT = pa.schema([
    ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
    ("terms", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()),
])
_HITS = pa.schema([
    ("segment", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
])


def build(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """The stored index of ``docs``; ``wanted`` leaves out the lists of all other terms."""
    index = docs.select("doc_id", "text").mapInArrow(tidy(lambda b: _segments(b, wanted)), SEGMENT)
    return stage(index, "phrase_index")


class Phrases:
    """Windows of a block of items: rows of terms, padded, with their item."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        column = pa.array([text or "" for _, text in items], pa.large_string())
        self.ids = [str(item) for item, _ in items]
        rows, lengths, owners = [], [], []
        for first, _, hashes, counts in wordhash.blocks(column, WORD):
            at = 0
            for i, n in enumerate(counts.tolist()):
                words = hashes[at:at + n]
                at += n
                width = min(window, n)
                for start in range(n - width + 1 if n else 0):
                    rows.append(np.pad(words[start:start + width], (0, window - width)))
                    lengths.append(width)
                    owners.append(first + i)
        self.terms = np.array(rows, np.uint64).reshape(-1, window)
        self.lengths = np.array(lengths, np.int64)
        self.owners = np.array(owners, np.int64)

    def vocabulary(self) -> np.ndarray:
        used = np.arange(self.terms.shape[1]) < self.lengths[:, None]
        return np.unique(self.terms[used])


class Segment:
    """The lists of one stored segment as one sorted array of (term number, place)."""

    def __init__(self, terms: bytes, sizes: bytes, places: bytes, n_words: list[int]):
        self.terms = np.frombuffer(terms, np.uint64)
        self.sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.places = np.frombuffer(places, np.uint32).astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.terms)), self.sizes) << 32) | self.places
        words = np.array(n_words, np.int64)
        self.starts = np.cumsum(words + 1) - (words + 1)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The local number of each term, -1 where the segment lacks it."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """``(phrase, start place)`` of all occurrences."""
        numbers = self.numbers(phrases.terms)
        used = np.arange(numbers.shape[1]) < phrases.lengths[:, None]
        alive = np.flatnonzero(((numbers >= 0) | ~used).all(axis=1))
        if not len(alive):
            return alive, alive
        numbers, used = numbers[alive], used[alive]
        sizes = np.where(used, self.sizes[numbers], np.iinfo(np.int64).max)
        rarest_first = np.argsort(sizes, axis=1, kind="stable")
        shift = rarest_first[:, 0]
        term = numbers[np.arange(len(alive)), shift]
        counts = self.sizes[term]
        phrase = np.repeat(np.arange(len(alive)), counts)
        within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = self.places[self.firsts[term[phrase]] + within] - shift[phrase]
        ok = start >= 0
        phrase, start = phrase[ok], start[ok]
        for turn in range(1, numbers.shape[1]):
            if not len(phrase):
                break
            shift = rarest_first[phrase, turn]
            keys = (numbers[phrase, shift] << 32) | (start + shift)
            ok = ~used[phrase, shift] | _members(self.keys, keys)
            phrase, start = phrase[ok], start[ok]
        return alive[phrase], start

    def row_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _search(batches: Iterator[pa.RecordBatch], phrases: Phrases):
    for batch in batches:
        for stored in batch.to_pylist():
            n_words = stored["n_words"]
            part = Segment(stored["terms"], stored["sizes"], stored["places"], n_words)
            phrase, start = part.occurrences(phrases)
            hits: list[list[int]] = [[] for _ in n_words]
            items: list[list[str]] = [[] for _ in n_words]
            if len(phrase):
                lengths = phrases.lengths[phrase]
                runs = np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
                places = np.unique(runs + np.arange(lengths.sum()))
                rows = part.row_of(places)
                for row in np.unique(rows).tolist():
                    own = rows == row
                    hits[row] = (places[own] - part.starts[row]).tolist()
                pairs = np.unique(
                    np.stack([part.row_of(start), phrases.owners[phrase]], axis=1), axis=0
                )
                for row, owner in pairs.tolist():
                    items[row].append(phrases.ids[owner])
                items = [list(dict.fromkeys(own)) for own in items]
            yield pa.RecordBatch.from_pydict({
                "segment": [stored["segment"]] * len(n_words),
                "row": list(range(len(n_words))),
                "doc_id": stored["doc_ids"],
                "n_words": n_words,
                "hits": hits,
                "items": items,
            }, schema=_HITS)


def search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """One row per document: its words, the places of hit words and the items found."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    return index.mapInArrow(tidy(lambda batches: _search(batches, shared.value)), HITS)


def _near(batches: Iterator[pa.RecordBatch], phrases: Phrases, width: int):
    for batch in batches:
        for stored in batch.to_pylist():
            part = Segment(stored["terms"], stored["sizes"], stored["places"], stored["n_words"])
            found: list[tuple] = []
            numbers = part.numbers(phrases.terms)
            for p, length in enumerate(phrases.lengths.tolist()):
                wanted = set(numbers[p, :length].tolist())
                if -1 in wanted:
                    continue
                lists = [part.places[part.firsts[t]:part.firsts[t + 1]] for t in wanted]
                rarest = min(lists, key=len)
                rows = np.unique(part.row_of(rarest))
                for row in rows.tolist():
                    low = part.starts[row]
                    high = low + stored["n_words"][row]
                    places = np.concatenate([x[(x >= low) & (x < high)] for x in lists])
                    owner = np.concatenate([
                        np.full(((x >= low) & (x < high)).sum(), i) for i, x in enumerate(lists)
                    ])
                    if _smallest_span(places, owner, len(lists)) <= width:
                        found.append((stored["doc_ids"][row], phrases.ids[phrases.owners[p]]))
            if found:
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([d for d, _ in found], pa.int64()),
                    "item_id": pa.array([i for _, i in found], pa.string()),
                })


def _smallest_span(places: np.ndarray, owner: np.ndarray, kinds: int) -> int:
    """Words from first to last of the tightest stretch that holds every kind."""
    order = np.argsort(places, kind="stable")
    places, owner = places[order], owner[order].tolist()
    held, left, best = [0] * kinds, 0, 1 << 62
    missing = kinds
    for right, kind in enumerate(owner):
        missing -= held[kind] == 0
        held[kind] += 1
        while not missing:
            best = min(best, int(places[right] - places[left]) + 1)
            held[owner[left]] -= 1
            missing += held[owner[left]] == 0
            left += 1
    return best


def near(index: DataFrame, phrases: Phrases, width: int) -> DataFrame:
    """``(doc_id, item_id)`` where all words of a phrase stand within ``width`` words."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)
    return index.mapInArrow(
        lambda batches: _near(batches, shared.value, width), "doc_id long, item_id string"
    ).distinct()


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size, each fetched when its turn comes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    parts = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for part in range(parts):
        yield [tuple(row) for row in items.where(place == part).orderBy("item_id").collect()]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, hits, items)`` for every row of ``docs``.

    The index is built with the lists of the benchmark's terms while these are at most
    ``TERMS_KEPT``, else with all lists. The items are searched in blocks.
    """
    wanted = np.zeros(0, np.uint64)
    for block in _blocks(benchmark):
        wanted = np.union1d(wanted, Phrases(block, window).vocabulary())
        if len(wanted) > TERMS_KEPT:
            wanted = None
            break
    index = build(docs, wanted)
    found = [search(index, Phrases(block, window)) for block in _blocks(benchmark)]
    if len(found) == 1:
        return found[0].drop("segment", "row")
    everything = found[0]
    for more in found[1:]:
        everything = everything.unionByName(more)
    return everything.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    ).drop("segment", "row")


def contamination(found: DataFrame) -> DataFrame:
    """Counts, digest of the items and the verdict for every document."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (CONTAMINATED * n_hit >= F.col("n_words"))).alias("contaminated"),
    )

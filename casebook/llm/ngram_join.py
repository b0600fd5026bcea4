"""Documents whose sets of word n-grams have a Jaccard similarity of at least 0.8.

Two sets that similar share a token among the first ``n - ceil(0.8 n) + 1`` of each, under any
order of all tokens. Several orders are used. In each, tokens come by how often their hash slot is
filled in the corpus, rare ones first, then by hash; slots, counts and hashes differ from order to
order, so an accidental meeting in one of them is unlikely in all.

1. ``profiles``: one pass hashes the n-grams. Documents with equal sets are one class; from here
   on one document stands for each. A parity sketch is kept of every set: two sets differ in at
   least as many tokens as their sketches in bits, so it can rule a pair out and never loses one.
2. ``meetings``: a second pass sends the prefix tokens of the first order, packed, to buckets by
   token; a token that only one class holds is dropped there.
3. Within each token's list, classes meet a few hubs, not each other; pairs that pass length and
   sketch are compared with the filters of the other orders and then exactly. Connected classes
   become components.
4. What is left are pairs of one list in different components: long lists are cut into blocks that
   meet two by two, and only pairs that pass length and sketch leave a task. A link inside a
   component that the hubs have joined needs no comparison, as it can't change the components.

Sets are read again from the texts, for the classes in such pairs only. No list, candidate or
partner is capped.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]`` with A-Z folded. A text of fewer words
than n has its whole sequence as its only n-gram; null and blank texts have the empty set, link
with nothing and are their own component, as do rows without an id (whose component is null).
N-grams are 64-bit hashes. Repeated rows share a component. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.llm import wordhash
from casebook.llm.memory import tidy
from casebook.sources.staging import bounded, stage, stage_alone

N = 5
PERCENT = 80
ORDERS = 3
SLOT_BITS = 20
SLOT_BLOCK = 1 << 14
BUCKET_TOKENS = 500_000
SPLIT_COUNT = 50_000  # a token with a fuller slot may be split over sub-buckets
SKETCH_CELLS = 512
HUBS = 12
LIST_BLOCK = 1_024
PAIRS_AT_ONCE = 100_000
#: Distinct pairs that a task holds before it hands them on; lists that share members repeat pairs.
PAIRS_HELD = 1_000_000

WORD = wordhash.byte_class((0x20, 0x20), (0x09, 0x0D))
_PLACE = wordhash._numbers(64, 3) | np.uint64(1)
_SALT = wordhash._numbers(16, 4)


def sets_of(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, ascending distinct n-gram hashes)`` of every row."""
    for first, _, hashes, counts in wordhash.blocks(column, WORD):
        grams = np.zeros(0, np.uint64)
        if len(hashes) >= n:
            m = len(hashes) - n + 1
            grams = hashes[:m] * _PLACE[0]
            for j in range(1, n):
                grams = grams + hashes[j:j + m] * _PLACE[j]
            grams = wordhash.mixed(grams)
        at = 0
        for i, words in enumerate(counts.tolist()):
            if words >= n:
                own = np.sort(grams[at:at + words - n + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif words:
                short = hashes[at:at + words] * _PLACE[:words]
                own = wordhash.mixed(np.array([short.sum() + np.uint64(words)], np.uint64))
            else:
                own = np.zeros(0, np.uint64)
            yield first + i, own
            at += words


def class_of(grams: np.ndarray) -> int:
    """A 63-bit key of a set, the same in any order of its members."""
    total = wordhash.mixed(grams ^ _SALT[0]).sum(dtype=np.uint64, keepdims=True)
    key = wordhash.mixed(total + np.array([len(grams)], np.uint64) * _SALT[1])
    return int(key[0] >> np.uint64(1))


def _slots(grams: np.ndarray, order: int) -> np.ndarray:
    return ((grams >> np.uint64(SLOT_BITS * order)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def prefix(grams: np.ndarray, order: int, counts: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set that come first in one order, as many as the threshold needs."""
    n = len(grams)
    length = n - -(-percent * n // 100) + 1
    if length >= n:
        return grams
    place = wordhash.mixed(grams ^ _SALT[2 + order]) >> np.uint64(16)
    place |= counts[order][_slots(grams, order)].astype(np.uint64) << np.uint64(48)
    return grams[np.argpartition(place, length - 1)[:length]]


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the members in cells, about as many cells as members, 512 at least."""
    cells = SKETCH_CELLS << max(0, (len(grams) - 1) // SKETCH_CELLS).bit_length()
    place = ((grams >> np.uint64(7)) & np.uint64(cells - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=cells) & 1).astype(bool)).tobytes()


class Sketches:
    """Sketches of several widths; a wide one folds to half its width by XOR of its halves."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed
        self.width = np.array([len(p) for p in packed], np.int64)
        self._folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The sketches of this width and of its double, and where each row's is."""
        if width not in self._folded:
            place = np.full(len(self.packed), -1)
            parts = []
            for times in (1, 2):
                rows = np.flatnonzero(self.width == width * times)
                place[rows] = np.arange(len(rows)) + sum(map(len, parts))
                data = np.frombuffer(b"".join([self.packed[r] for r in rows.tolist()]), np.uint64)
                data = data.reshape(len(rows), times, width // 8)
                parts.append(np.bitwise_xor.reduce(data, axis=1))
            self._folded[width] = np.concatenate(parts), place
        return self._folded[width]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing bits of pairs of rows; 0 where the widths are too unlike to compare."""
        bits = np.zeros(len(a), np.int64)
        level = np.minimum(self.width[a], self.width[b])
        for width in np.unique(level).tolist():
            data, place = self._at(width)
            own = np.flatnonzero((level == width) & (place[a] >= 0) & (place[b] >= 0))
            for start in range(0, len(own), PAIRS_AT_ONCE):
                part = own[start:start + PAIRS_AT_ONCE]
                x = data[place[a[part]]] ^ data[place[b[part]]]
                bits[part] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        return bits


def most_different(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The most tokens that two linked sets of these sizes hold apart."""
    return (a + b) * (100 - percent) // (100 + percent)


# --- 1. classes and slot counts ---------------------------------------------------------------

_PROFILE = pa.schema([
    ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()),
    ("sketch", pa.binary()), ("block", pa.int32()), ("counts", pa.binary()),
])


def _profiles(batches: Iterator[pa.RecordBatch], n: int):
    slots = np.zeros((ORDERS, 1 << SLOT_BITS), np.uint32)
    waiting, held = [], 0

    def count():
        joined = np.concatenate(waiting)
        for order in range(ORDERS):
            slots[order] += np.bincount(_slots(joined, order), minlength=1 << SLOT_BITS).astype(np.uint32)
        waiting.clear()

    for batch in batches:
        sizes, classes, sketches = [], [], []
        for _, grams in sets_of(batch.column(1), n):
            sizes.append(len(grams))
            classes.append(class_of(grams) if len(grams) else None)
            sketches.append(sketch(grams) if len(grams) else None)
            if len(grams):
                waiting.append(grams)
                held += len(grams)
                if held > 1 << 20:
                    count()
                    held = 0
        none = [None] * len(sizes)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
             pa.array(sketches, pa.binary()), pa.array(none, pa.int32()),
             pa.array(none, pa.binary())], schema=_PROFILE)
    if waiting:
        count()
    flat = slots.reshape(-1, SLOT_BLOCK)
    used = np.flatnonzero(flat.any(axis=1)).tolist()
    if used:
        none = [None] * len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
             pa.array(none, pa.binary()), pa.array(used, pa.int32()),
             pa.array([zlib.compress(flat[b].tobytes(), 1) for b in used], pa.binary())],
            schema=_PROFILE)


def _summed(batches: Iterator[pa.RecordBatch]):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).astype(np.uint64)
            totals[block] = totals[block] + counts if block in totals else counts
    if totals:
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(list(totals), pa.int32()),
            "counts": pa.array(
                [np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes() for c in totals.values()],
                pa.binary()),
        })


def profiles(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """``(doc_id, n_shingles, class, sketch)`` of every row, and the slot counts of all orders.

    The counts are a table of fixed size; tasks send theirs in blocks, which are added up in
    two steps so that no task meets the blocks of all others.
    """
    both = stage(
        docs.select("doc_id", "text").mapInArrow(
            tidy(lambda b: _profiles(b, n)),
            "doc_id long, n_shingles long, class long, sketch binary, block int, counts binary",
        ),
        "profiles",
    )
    blocks = both.where("block is not null").select(
        "block", "counts", (F.spark_partition_id() % 64).alias("part"))
    summed = blocks.repartition("block", "part").select("block", "counts").mapInArrow(
        _summed, "block int, counts binary")
    total = np.zeros(((ORDERS << SLOT_BITS) // SLOT_BLOCK, SLOT_BLOCK), np.uint64)
    for row in summed.toLocalIterator():
        total[row["block"]] += np.frombuffer(row["counts"], np.uint32)
    counts = np.minimum(total, 0xFFFF).astype(np.uint16).reshape(ORDERS, -1)
    return both.where("block is null").select(
        "doc_id", "n_shingles", "class", "sketch"), counts


# --- 2. tokens that several classes meet at ---------------------------------------------------


def _postings(batches: Iterator[pa.RecordBatch], n: int, percent: int, counts, buckets: int):
    seen: set[int] = set()
    for batch in batches:
        tokens, classes, split = [], [], []
        for _, grams in sets_of(batch.column(0), n):
            if not len(grams):
                continue
            own = class_of(grams)
            if own in seen:
                continue
            seen.add(own)
            first = prefix(grams, 0, counts.value, percent)
            tokens.append(first)
            classes.append(np.full(len(first), own, np.int64))
        if not tokens:
            continue
        token, owner = np.concatenate(tokens), np.concatenate(classes)
        bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        hot = counts.value[0][_slots(token, 0)] >= min(SPLIT_COUNT, 0xFFFF)
        bucket = np.where(hot, bucket + buckets * (1 + owner % 16), bucket)
        order = np.argsort(bucket, kind="stable")
        bucket, token, owner = bucket[order], token[order].astype(np.uint32), owner[order]
        firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(firsts[1:], len(bucket))
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(bucket[firsts], pa.int64()),
            "tokens": pa.array([token[a:b].tobytes() for a, b in zip(firsts, ends)], pa.binary()),
            "classes": pa.array([owner[a:b].tobytes() for a, b in zip(firsts, ends)], pa.binary()),
        })


def _shared(table: pa.Table, buckets: int) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    token = np.frombuffer(b"".join(table.column("tokens").to_pylist()), np.uint32)
    owner = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.int64)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    same = token[1:] == token[:-1]
    new = np.concatenate([[True], ~(same & (owner[1:] == owner[:-1]))])
    token, owner = token[new], owner[new]
    same = token[1:] == token[:-1]
    kept = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if bucket >= buckets:  # one part of a split token: the other parts are elsewhere
        kept = np.ones(len(token), bool)
    token = token[kept].astype(np.int64) | ((bucket % buckets) << 32)
    return pa.table({"token": pa.array(token, pa.int64()), "class": pa.array(owner[kept], pa.int64())})


def meetings(docs: DataFrame, n: int, percent: int, counts, total: int) -> DataFrame:
    """``(token, class)`` for the first order's prefix tokens that several classes hold."""
    buckets = max(24, total * (100 - percent) // 100 // BUCKET_TOKENS)
    packed = docs.select("text").mapInArrow(
        tidy(lambda b: _postings(b, n, percent, counts, buckets)),
        "bucket long, tokens binary, classes binary",
    )
    shared = packed.groupBy("bucket").applyInArrow(
        lambda table: _shared(table, buckets), "token long, class long")
    return stage(shared, "meetings")


# --- 3. sets read again ------------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    seen: set[int] = set()
    for batch in batches:
        rows = {}
        for _, grams in sets_of(batch.column(0), n):
            own = class_of(grams)
            if own not in seen:
                seen.add(own)
                rows[own] = grams.tobytes()
        yield pa.RecordBatch.from_pydict({
            "class": pa.array(list(rows), pa.int64()),
            "grams": pa.array(list(rows.values()), pa.binary()),
        })


def sets_for(docs: DataFrame, known: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``(class, grams)`` for the classes of ``pairs``, each from the document of least id.

    Rows that repeat an id may give a class once per task.
    """
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    wanted = known.join(needed, "class").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    wanted = stage(wanted.select("doc_id").distinct(), "wanted")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    texts = texts.join(bounded(wanted, 2_000_000), "doc_id", "left_semi").select("text")
    return stage(texts.mapInArrow(tidy(lambda b: _sets(b, n)), "class long, grams binary"), "sets")


# --- 4. pairs, links, components --------------------------------------------------------------


def _plausible(batches: Iterator[pa.RecordBatch], percent: int):
    """Rows of ``(a, n_a, sketch_a, b, n_b, sketch_b)`` that the sketches don't rule out."""
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        a, b = batch.column(1).to_numpy(), batch.column(4).to_numpy()
        both = Sketches(batch.column(2).to_pylist() + batch.column(5).to_pylist())
        apart = both.apart(np.arange(m), np.arange(m, 2 * m))
        kept = batch.filter(pa.array(apart <= most_different(a, b, percent)))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3)], ["a", "b"])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def hub_pairs(met: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Each class of a list with the hubs of the list: its least classes under a few hashes."""
    hubs = met.groupBy("token").agg(*[
        F.min_by("class", F.xxhash64("class", F.lit(h))).alias(f"hub{h}") for h in range(HUBS)
    ])
    pairs = met.join(hubs, "token").select(
        F.col("class").alias("a"),
        F.explode(F.array_distinct(F.array(*[f"hub{h}" for h in range(HUBS)]))).alias("b"))
    pairs = _ordered(pairs.where("a <> b"))
    first = traits.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    second = traits.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(first, "a").join(second, "b").where(fit)
    return both.select("a", "n_a", "s_a", "b", "n_b", "s_b").mapInArrow(
        lambda rows: _plausible(rows, percent), "a long, b long")


def _left(batches: Iterator[pa.RecordBatch], percent: int):
    """Pairs of one list block, or of two, in different components, not ruled out.

    The rows come in order of their list and blocks; a group that a batch cuts is carried over.
    """
    carried = None
    pending, held = [], 0
    for batch in itertools.chain(batches, [None]):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if carried is not None:
            table = carried if table is None else pa.concat_tables([carried, table])
        if table is None or not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in ("token", "left", "right")]
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        firsts = np.flatnonzero(new)
        stop = table.num_rows if batch is None else int(firsts[-1])
        carried = table.slice(stop) if batch is not None else None
        if not stop:
            continue
        ends = np.append(firsts, table.num_rows)
        ends = ends[ends <= stop]
        end = np.repeat(ends[1:], np.diff(ends))
        ids, n = table.column("class").to_numpy(), table.column("n").to_numpy()
        comp, home = table.column("comp").to_numpy(), table.column("home").to_numpy()
        two = keys[1] != keys[2]
        sketches = Sketches(table.column("sketch").to_pylist())
        partners = end - np.arange(stop) - 1
        upto = np.cumsum(partners)
        row = 0
        found = []
        while row < stop:
            base = upto[row] - partners[row]
            until = max(row + 1, int(np.searchsorted(upto, base + 10 * PAIRS_AT_ONCE, "right")))
            counts = partners[row:until]
            a = np.repeat(np.arange(row, until), counts)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
            ok = (comp[a] != comp[b]) & (~two[a] | (home[a] != home[b]))
            ok &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            ok = sketches.apart(a, b) <= most_different(n[a], n[b], percent)
            a, b = ids[a[ok]], ids[b[ok]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            row = until
        pending.append(np.unique(np.concatenate(found, axis=1), axis=1))
        held += pending[-1].shape[1]
        if held > PAIRS_HELD:
            pending = [np.unique(np.concatenate(pending, axis=1), axis=1)]
            held = pending[0].shape[1]
            if held > PAIRS_HELD // 2:
                yield _pair_batch(pending[0])
                pending, held = [], 0
    if pending:
        yield _pair_batch(np.unique(np.concatenate(pending, axis=1), axis=1))


def _pair_batch(pairs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])


def left_pairs(met: DataFrame, labels: DataFrame, traits: DataFrame, percent: int) -> DataFrame:
    """Pairs of a list that are in different components so far and not ruled out."""
    named = met.join(labels, met["class"] == labels["node"], "left").select(
        "token", "class", F.coalesce("label", "class").alias("comp"))
    open_ = named.groupBy("token").agg(
        F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")
    ).where("low <> high").select("token", F.ceil(F.col("size") / LIST_BLOCK).cast("int").alias("parts"))
    placed = named.join(open_, "token").join(traits, "class").withColumn(
        "home", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met_ = placed.select("token", "class", "n", "sketch", "comp", "home", other).select(
        "token", "class", "n", "sketch", "comp", "home",
        F.least("home", "other").alias("left"), F.greatest("home", "other").alias("right"))
    keys = ["token", "left", "right"]
    dealt = met_.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(lambda rows: _left(rows, percent)), "a long, b long").distinct()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many of ``x`` are in the sorted ``y``."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _verified(batches: Iterator[pa.RecordBatch], percent: int, counts):
    def shares(x, y):
        return all(
            _common(prefix(x, k, counts.value, percent), np.sort(prefix(y, k, counts.value, percent)))
            for k in range(1, ORDERS)
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        links = []
        (left, at_left), (right, at_right) = [wordhash.cells(batch.column(i)) for i in (2, 3)]
        ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        for i, (a, b) in enumerate(ids):
            x = left[at_left[i]:at_left[i + 1]].view(np.uint64)
            y = right[at_right[i]:at_right[i + 1]].view(np.uint64)
            if len(x) > len(y):
                x, y = y, x
            if shares(x, y):
                both = _common(x, y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
        yield pa.RecordBatch.from_pydict({
            "a": pa.array([a for a, _ in links], pa.int64()),
            "b": pa.array([b for _, b in links], pa.int64()),
        })


def links(pairs: DataFrame, sets: DataFrame, percent: int, counts) -> DataFrame:
    """The pairs that share prefix tokens in every other order and reach the similarity."""
    x = sets.select(F.col("class").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return both.mapInArrow(tidy(lambda rows: _verified(rows, percent, counts)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node reachable, for every node of ``edges``.

    Every round points each node at its least neighbour, follows the pointers twice and contracts
    the graph; hashed node ids shrink it by a constant factor a round.
    """
    edges = stage(edges.where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stage(nodes.withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        lowest = stage(lowest, "lowest")
        for _ in range(2):
            jump = lowest.select(F.col("a").alias("m"), F.col("m").alias("further"))
            lowest = lowest.join(jump, "m").select("a", F.col("further").alias("m"))
        lowest = stage(lowest, "pointers")
        low_a = lowest.select("a", F.col("m").alias("x"))
        low_b = lowest.select(F.col("a").alias("b"), F.col("m").alias("y"))
        edges = stage(
            edges.join(low_a, "a").join(low_b, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        to = lowest.select(F.col("a").alias("label"), "m")
        labels = stage(
            labels.join(to, "label", "left").select("node", F.coalesce("m", "label").alias("label")),
            "labels",
        )
    return labels


def similar(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, class, component_id)`` for every row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    known, slots = profiles(docs, n)
    counts = spark.sparkContext.broadcast(slots)
    total = known.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    met = meetings(docs, n, percent, counts, total)
    traits = known.where("class is not null").groupBy("class").agg(
        F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))

    def linked(pairs, name):
        def found():
            staged = stage(pairs, f"{name}_pairs")
            return links(staged, sets_for(docs, known, staged, n), percent, counts)

        return stage_alone(found, f"{name}_links")

    first = linked(hub_pairs(met, traits, percent), "hub")
    labels = components(first)
    second = linked(left_pairs(met, labels, traits, percent), "left")
    labels = components(first.union(second))
    named = known.join(labels, known["class"] == labels["node"], "left").select(
        "doc_id", "n_shingles", "class", F.coalesce("label", "class").alias("label"))
    named = stage(named, "named")
    least = named.where("label is not null").groupBy("label").agg(
        F.min("doc_id").alias("component_id"), F.count("*").alias("size"))
    least = least.where("size > 1").drop("size")
    return named.join(least, "label", "left").select(
        "doc_id", "n_shingles", "class",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))

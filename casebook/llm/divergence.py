"""Which words set a source of documents apart from its language, and how far sources lie apart.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z as a-z. A language keeps the
terms of at least ``least_docs`` of its documents. A group, a (lang, source) pair or a whole
language, gives every kept term the share ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``: ``N`` is
the group's number of kept terms, ``V`` the language's number of different ones. All integers.

Terms travel as 64-bit digests. The reading tasks count them by source and document, so what is
shuffled has a fixed width and every key is counted before it moves. A second reading holds every
occurrence of a kept digest against its task's string for it and tells the least and greatest string
of the digest (a bit filter of fixed size keeps the others from the shuffle; what it lets through by
chance is dropped by a join). Digests whose least and greatest strings differ are split: their words
are counted anew by string. Texts join only the rows that
are put out and those that tie with them.

Null text, lang and source are empty. A language without a kept term has distance 0 between all
its sources and no term rows. Repeated rows count as often as they occur. Texts are read
in blocks of about 2 MB; a longer one is a block of its own and takes some thirty times its size. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from casebook.llm.wordhash import byte_class, texts, word_hashes
from casebook.sources.staging import stage

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Bits of the filter of kept digests: 8 MB, whatever the vocabulary.
FILTER_BITS = 1 << 26
#: Counts that a reading task holds before it hands them on.
HELD = 400_000
_BLOCK = 2 << 20
WORD = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _folded(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


# --- reading ------------------------------------------------------------------------------------


def _digest(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes if bits == 64 else hashes & np.uint64((1 << bits) - 1)


def _blocks(batch: pa.RecordBatch):
    """``(first row, data, offsets)`` of consecutive rows of about ``_BLOCK`` bytes."""
    data, offsets = texts(batch.column("text"))
    first, n = 0, batch.num_rows
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + _BLOCK, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, data, offsets[first:end + 1]
        first = end


def _groups(batch: pa.RecordBatch, known: dict) -> np.ndarray:
    """A task's own number of every row's (lang, source)."""
    lang, source = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
    width = max(1, len(source.dictionary))
    cells = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    names, places = np.unique(cells, return_inverse=True)
    numbers = [
        known.setdefault((lang.dictionary[c // width].as_py(), source.dictionary[c % width].as_py()),
                         len(known))
        for c in names.tolist()
    ]
    return np.array(numbers, np.int64)[places]


def _summed(keys: tuple[np.ndarray, ...], values: tuple[np.ndarray, ...]):
    """Distinct keys and the sums of their values."""
    order = np.lexsort(keys)
    keys, values = [k[order] for k in keys], [v[order] for v in values]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return [k[starts] for k in keys], [np.add.reduceat(v, starts) for v in values]


def _counts(hashes: np.ndarray, rows: np.ndarray, groups: np.ndarray):
    """``(digest, group, count, documents)`` of a block's words; ``rows`` numbers their texts."""
    terms, places = np.unique(hashes, return_inverse=True)
    n = int(rows[-1]) + 1
    pairs, times = np.unique(places.astype(np.int64) * n + rows, return_counts=True)
    term, group = pairs // n, groups[pairs % n]
    (group, term), (count, docs) = _summed(
        (group, term), (times.astype(np.int64), np.ones(len(pairs), np.int64)))
    return terms[term], group, count, docs


def _reader(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        held, size = [], 0

        def merged():
            digest, group, count, docs = (np.concatenate(c) for c in zip(*held))
            (group, digest), (count, docs) = _summed((group, digest), (count, docs))
            return digest, group, count, docs

        def batch_of(digest, group, count, docs):
            names = list(known)
            langs, sources = (pa.array([n[i] for n in names], pa.string()) for i in (0, 1))
            place = pa.array(group)
            return pa.RecordBatch.from_arrays(
                [langs.take(place), sources.take(place), pa.array(digest.view(np.int64)),
                 pa.array(count), pa.array(docs)], ["lang", "source", "digest", "n", "docs"])

        for batch in batches:
            groups = _groups(batch, known)
            for first, data, offsets in _blocks(batch):
                hashes, words = word_hashes(data, offsets, WORD)
                if not len(hashes):
                    continue
                rows = np.repeat(np.arange(len(words)), words)
                part = _counts(_digest(hashes, bits), rows, groups[first:first + len(words)])
                held.append(part)
                size += len(part[0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*merged())

    return run


def term_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``(lang, digest, docs, cells)`` of every term: its documents and its count by source."""
    counted = _folded(docs).mapInArrow(
        _reader(bits), "lang string, source string, digest long, n long, docs long")
    by_source = counted.groupBy("lang", "digest", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "digest").agg(
        F.sum("docs").alias("docs"),
        F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("cells"))


# --- strings of kept digests --------------------------------------------------------------------


def _bit(digest: Column) -> Column:
    return F.pmod(digest, F.lit(FILTER_BITS))


def _filter(kept: DataFrame) -> np.ndarray:
    """A bit for every kept digest. The driver sees 64-bit words of a table of fixed size."""
    place = _bit(F.col("digest"))
    words = kept.select(
        F.shiftright(place, 6).cast("int").alias("place"),
        F.expr(f"shiftleft(1L, cast(pmod(digest, {FILTER_BITS}) % 64 as int))").alias("bits"),
    ).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    table = words.toArrow()
    filled[table["place"].to_numpy()] = table["bits"].to_numpy()
    return filled.view(np.uint64)


def _passing(digest: np.ndarray, filled: np.ndarray) -> np.ndarray:
    bit = digest & np.uint64(FILTER_BITS - 1)
    return (filled[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _spans(data: np.ndarray, offsets: np.ndarray):
    """A block's bytes with A-Z folded, and the starts and lengths of its words in order."""
    block = _FOLDED[data[int(offsets[0]):int(offsets[-1])]]
    inside = WORD[block]
    edges = (offsets - offsets[0])[1:-1]
    edges = edges[(edges > 0) & (edges < len(block))]
    opens, shuts = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edges] = inside[edges]
    shuts[:-1] &= ~inside[1:]
    shuts[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    return block, starts, np.flatnonzero(shuts) + 1 - starts


def _flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of the given stretches, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class _Strings:
    """One string for every hash that a task has met, and the check of all others against it."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.starts = self.lengths = np.zeros(0, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def add(self, hashes, block, starts, lengths) -> None:
        moved = np.cumsum(lengths) - lengths + len(self.bytes)
        self.bytes = np.concatenate([self.bytes, block[_flat(starts, lengths)]])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.starts = np.concatenate([self.starts, moved])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]

    def differing(self, hashes, block, starts, lengths) -> np.ndarray:
        """The words whose bytes are not those kept for their hash."""
        at = np.searchsorted(self.hashes, hashes)
        same = self.lengths[at] == lengths
        i = np.flatnonzero(same)
        own = block[_flat(starts[i], lengths[i])]
        unequal = own != self.bytes[_flat(self.starts[at[i]], lengths[i])]
        if unequal.any():
            ends = np.cumsum(lengths[i])
            same[i] = np.add.reduceat(unequal.astype(np.int64), ends - lengths[i]) == 0
        return np.flatnonzero(~same)


def _decoded(block, starts, lengths) -> list[str]:
    raw = block.tobytes()
    return [raw[a:a + n].decode() for a, n in zip(starts.tolist(), lengths.tolist())]


def _stringer(bits: int, filled):
    """``(digest, term)`` for every string of a kept digest, seldom more than once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Strings()
        for batch in batches:
            for _, data, offsets in _blocks(batch):
                hashes, _ = word_hashes(data, offsets, WORD)
                wanted = np.flatnonzero(_passing(_digest(hashes, bits), filled.value))
                if not len(wanted):
                    continue
                block, starts, lengths = _spans(data, offsets)
                hashes, starts, lengths = hashes[wanted], starts[wanted], lengths[wanted]
                if len(known.hashes) > HELD:
                    known = _Strings()
                full, at = np.unique(hashes, return_index=True)
                new = at[~np.isin(full, known.hashes, assume_unique=True)]
                known.add(hashes[new], block, starts[new], lengths[new])
                out = np.concatenate([new, known.differing(hashes, block, starts, lengths)])
                if len(out):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_digest(hashes[out], bits).view(np.int64)),
                         pa.array(_decoded(block, starts[out], lengths[out]), pa.string())],
                        ["digest", "term"])

    return run


def _splitter(bits: int, filled):
    """``(lang, source, digest, term, n, docs)`` of the words whose digests may be ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for first, data, offsets in _blocks(batch):
                hashes, words = word_hashes(data, offsets, WORD)
                digest = _digest(hashes, bits)
                wanted = np.flatnonzero(_passing(digest, filled.value))
                if not len(wanted):
                    continue
                block, starts, lengths = _spans(data, offsets)
                rows = first + np.repeat(np.arange(len(words)), words)[wanted]
                counts: dict = {}
                for row, d, term in zip(
                    rows.tolist(), digest[wanted].view(np.int64).tolist(),
                    _decoded(block, starts[wanted], lengths[wanted]),
                ):
                    key = langs[row], sources[row], d, term
                    n, docs, last = counts.get(key, (0, 0, None))
                    counts[key] = n + 1, docs + (row != last), row
                yield pa.RecordBatch.from_pylist([
                    dict(zip(("lang", "source", "digest", "term"), key), n=n, docs=docs)
                    for key, (n, docs, _) in counts.items()
                ], _SPLIT)

    return run


_SPLIT = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("term", pa.string()),
    ("n", pa.int64()), ("docs", pa.int64()),
])
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64) -> DataFrame:
    """``(lang, digest, term, cells)`` of the terms in at least ``least_docs`` documents of a language.

    ``cells`` maps sources to counts. ``term`` is set for strings that share their digest with
    another one only; :func:`strings` has the others. ``bits`` is the width of the digests.
    """
    return _kept(docs, least_docs, bits)[0]


def _kept(docs: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    spark, rows = docs.sparkSession, _folded(docs)
    enough = F.col("docs") >= least_docs
    kept = stage(term_counts(docs, bits).where(enough).drop("docs"), "kept")
    filled = spark.sparkContext.broadcast(_filter(kept))
    found = rows.select("text").mapInArrow(_stringer(bits, filled), "digest long, term string")
    named = stage(
        found.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high"))
        .join(kept.select("digest").distinct(), "digest", "left_semi"), "strings")
    torn = named.where("low <> high").select("digest")
    kept = kept.withColumn("term", F.lit(None).cast("string"))
    if torn.isEmpty():
        return kept, named
    again = spark.sparkContext.broadcast(_filter(torn))
    counted = rows.mapInArrow(
        _splitter(bits, again),
        "lang string, source string, digest long, term string, n long, docs long",
    ).join(torn, "digest", "left_semi")
    by_source = counted.groupBy("lang", "digest", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    parted = by_source.groupBy("lang", "digest", "term").agg(
        F.sum("docs").alias("docs"),
        F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("cells"))
    whole = kept.join(torn, "digest", "left_anti").unionByName(parted.where(enough).drop("docs"))
    return stage(whole, "split"), named


# --- shares and distances -----------------------------------------------------------------------


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 terms))``, without rounding or overflow."""
    wide = (count + SMOOTHING).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total + SMOOTHING * terms).cast("decimal(19,0)")
    return (F.lit(1) + F.call_function("div", wide, under)).cast("long")


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, sources, total, terms)``: every source that occurs with its number of kept terms."""
    cells = kept.select("lang", F.explode("cells").alias("source", "n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = _folded(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    by_lang = groups.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n"))))
        .alias("sources"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    return by_lang.join(terms, "lang", "left").withColumn(
        "terms", F.coalesce("terms", F.lit(0)).cast("long"))


def _shares(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """Kept terms with ``q``, the language's share, and ``ps``, the share of every source."""
    count = F.aggregate(F.map_values("cells"), F.lit(0).cast("long"), lambda a, b: a + b)
    joined = kept.join(langs, "lang")
    return joined.select(
        "lang", "digest", "term",
        _share(count, F.col("total"), F.col("terms")).alias("q"),
        F.transform("sources", lambda s: F.struct(
            s["source"].alias("source"),
            F.try_element_at("cells", s["source"]).alias("n"),
            _share(F.coalesce(F.try_element_at("cells", s["source"]), F.lit(0)).cast("long"),
                   s["n"], F.col("terms")).alias("p"))).alias("ps"),
    )


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``|p - q|`` for each pair of sources; a task holds one number for each pair."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        column = batch.column("lang").dictionary_encode()
        own = column.indices.to_numpy()
        lists = batch.column("p")
        for i, lang in enumerate(column.dictionary.to_pylist()):
            rows = np.flatnonzero(own == i)
            width = pc.list_value_length(lists)[int(rows[0])].as_py()
            step = max(1, (1 << 20) // width)
            for at in range(0, len(rows), step):
                some = lists.take(pa.array(rows[at:at + step])).flatten()
                shares = some.to_numpy().reshape(-1, width)
                total = sums.setdefault(lang, np.zeros((width, width), np.int64))
                for a in range(width - 1):
                    total[a, a + 1:] += np.abs(shares[:, a + 1:] - shares[:, a:a + 1]).sum(0)
    for lang, total in sums.items():
        for a in range(len(total) - 1):
            n = len(total) - 1 - a
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array(np.full(n, a, np.int32)),
                 pa.array(np.arange(a + 1, a + 1 + n, dtype=np.int32)), pa.array(total[a, a + 1:])],
                ["lang", "a", "b", "value"])


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(order).cast("int").alias("rank"))


def pair_distances(shares: DataFrame, langs: DataFrame) -> DataFrame:
    """The distance of every source from every other one of its language."""
    sums = shares.select("lang", F.col("ps.p").alias("p")).mapInArrow(
        _distances, "lang string, a int, b int, value long",
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ones = langs.select("lang", "sources.source", F.posexplode("sources.source").alias("i", "one"))
    pairs = ones.select("lang", "i", F.col("one"), F.posexplode("source").alias("j", "item")).where(
        "i <> j")
    pairs = pairs.select(
        "lang", F.col("one").alias("source"), "item",
        F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    found = pairs.join(sums, ["lang", "a", "b"], "left")
    return found.select(
        "lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def marking_terms(shares: DataFrame, named: DataFrame, most: int = TOP_TERMS) -> DataFrame:
    """The terms that a source uses more than its language, by the difference of the shares.

    Ranks are told without strings first, ties with the last rank included; these rows get theirs.
    """
    over = F.filter("ps", lambda s: (s["n"] > 0) & (s["p"] > F.col("q")))
    rows = shares.select("lang", "digest", "term", "q", F.explode(over).alias("s")).select(
        "lang", "s.source", "digest", "term", (F.col("s.p") - F.col("q")).alias("value"))
    place = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    leading = rows.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return leading.join(named.select("digest", "low"), "digest").select(
        "lang", "source", F.coalesce("term", "low").alias("item"), "value")


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = TOP_TERMS, bits: int = 64
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances (``pair``) and terms (``term``)."""
    kept, named = _kept(docs, least_docs, bits)
    langs = stage(languages(docs, kept), "languages")
    shares = stage(_shares(kept, langs), "shares")
    terms = _ranked(marking_terms(shares, named, most), "term").where(F.col("rank") <= most)
    return _ranked(pair_distances(shares, langs), "pair").unionByName(terms)

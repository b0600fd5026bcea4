"""TF-IDF: vocabulary relation, transformation, long and vector form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from casebook.sources.staging import bounded, lean, stage
from casebook.sources.tables import SPARSE

MAX_FEATURES = 50_000
MIN_DF = 3
MAX_DF = 0.95
# Shortest word of a term, in characters.
SHORTEST = 2
# Terms that a task counts together.
TERMS_AT_ONCE = 1 << 20


def with_bigrams(tokens: Column, shortest: int = SHORTEST) -> Column:
    """Words of at least ``shortest`` characters, followed by their bigrams."""
    w = F.filter(tokens, lambda t: F.char_length(t) >= shortest)
    pairs = F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))),
        F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(w, pairs)


def with_terms(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Replace the token column by ``terms``: uni- and bigrams."""
    return docs.withColumn("terms", with_bigrams(F.col(tokens))).drop(tokens)


def _with_pairs(rows: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple:
    """:func:`with_bigrams` of coded words (-1: null): rows and codes of the terms, and the terms."""
    long_enough = pc.greater_equal(pc.utf8_length(words), SHORTEST).to_numpy(zero_copy_only=False)
    kept = codes >= 0
    kept[kept] = long_enough[codes[kept]]
    rows, codes = rows[kept], codes[kept].astype(np.int64)
    at = np.flatnonzero(rows[1:] == rows[:-1])
    width = max(1, len(words))
    pairs = pa.array(codes[at] * width + codes[at + 1]).dictionary_encode()
    found = pairs.dictionary.to_numpy()
    both = pc.binary_join_element_wise(
        words.take(pa.array(found // width)), words.take(pa.array(found % width)), " ")
    terms = pa.concat_arrays([words, both])
    rows = np.concatenate([rows, rows[at]])
    codes = np.concatenate([codes, pairs.indices.to_numpy() + len(words)])
    if pc.any(pc.match_substring(words, " ")).as_py():  # a word and a bigram may be the same term
        same = terms.dictionary_encode()
        codes, terms = same.indices.to_numpy()[codes], same.dictionary
    return rows, codes, terms


def _coded(column: pa.Array, bigrams: bool = False) -> Iterator[tuple]:
    """Some rows of a list column at a time: the first row, and for every distinct (row, term) the
    row's number from there, the term's number and how often it occurs; then the terms.

    In order of rows. ``bigrams`` takes a column of words; some of the terms may then not occur."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    most = TERMS_AT_ONCE // 2 if bigrams else TERMS_AT_ONCE
    first, done = 0, 0
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
        flat = pc.list_flatten(column.slice(first, end - first)).dictionary_encode()
        rows = np.repeat(np.arange(end - first, dtype=np.int64), sizes[first:end])
        codes, terms = flat.indices.fill_null(-1).to_numpy(), flat.dictionary
        if bigrams:
            rows, codes, terms = _with_pairs(rows, codes, terms)
        width = max(1, len(terms))
        cells, counts = np.unique(rows * width + codes, return_counts=True)
        yield first, cells // width, cells % width, counts, terms
        first, done = end, int(ends[end - 1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows, terms, counts, names in _coded(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows + first)), names.take(pa.array(terms)),
                 pa.array(counts, pa.int64())], [batch.schema.names[0], "term", "tf"])


def term_counts(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, term, tf)``: rows are counted where they lie; only those that share an id meet."""
    lean(docs.sparkSession)
    ids = docs.groupBy(F.col(id_column).alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    shared = bounded(stage(ids.where("n > 1").select("_id"), "shared_ids"))
    rows = docs.select(id_column, "terms")
    schema = T.StructType([
        rows.schema[id_column], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    same = F.col(id_column).eqNullSafe(F.col("_id"))
    alone, meeting = (
        rows.join(shared, same, how).mapInArrow(_counted, schema) for how in ("left_anti", "left_semi"))
    return alone.unionByName(
        meeting.groupBy(id_column, "term").agg(F.sum("tf").alias("tf")))


def _summer(bigrams: bool):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, terms, counts, names in _coded(batch.column(0), bigrams):
                width = len(names)
                df, cf = np.bincount(terms, minlength=width), np.bincount(terms, counts, width)
                seen = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(seen)), pa.array(df[seen], pa.int64()),
                     pa.array(cf[seen].astype(np.int64))], ["term", "df", "cf"])
            pa.default_memory_pool().release_unused()

    return summed


def term_statistics(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """``(term, df, cf)``: documents with the term, and its total count.

    Tasks count many rows together, then one shuffle of distinct terms adds up both numbers. The
    terms lie in ``terms``; with ``tokens`` they are the words and bigrams of that column, which
    the tasks pair themselves.
    """
    lean(docs.sparkSession)
    found = docs.select(tokens or "terms").mapInArrow(
        _summer(tokens is not None), "term string, df long, cf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def most_frequent(counts: DataFrame, count: str, term: str, k: int) -> DataFrame:
    """The ``k`` rows of a staged table with the largest counts, ties by term.

    The count at which the ``k``-th row stands is found from the number of rows per count. Rows
    above it stay by a filter; only the rows at it are put in order.
    """
    by_count = counts.groupBy(count).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.orderBy(F.desc(count)))
    edge = (
        by_count.withColumn("upto", upto).where(F.col("upto") >= k).orderBy(F.desc(count)).first()
    )
    if edge is None:
        return counts
    above = counts.where(F.col(count) > edge[count])
    ties = counts.where(F.col(count) == edge[count])
    room = k - (edge["upto"] - edge["rows"])
    return above.unionByName(ties if room == edge["rows"] else ties.orderBy(term).limit(room))


def fit_vocabulary(
    docs: DataFrame,
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    tokens: str | None = None,
) -> DataFrame:
    """``(term_id, term, df, cf, idf)`` from the ``terms`` of the training documents, or from
    the words and bigrams of their ``tokens`` column.

    Terms outside ``[min_df, max_df * documents]`` go first, then the ``max_features`` most
    frequent stay (ties by term). Ids follow the order of the terms. The smooth idf is
    ``ln((1 + documents) / (1 + df)) + 1``.
    """
    n = docs.agg(F.count(F.lit(1))).scalar()
    fitting = stage(
        term_statistics(docs, tokens).where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n)),
        "term_statistics",
    )
    frequent = most_frequent(fitting, "cf", "term", max_features)
    by_term = Window.orderBy("term")  # max_features rows at most
    return frequent.select(
        (F.row_number().over(by_term) - 1).alias("term_id"),
        "term",
        "df",
        "cf",
        (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"),
    )


def _weigher(vocabulary: DataFrame, bigrams: bool):
    """A function of list columns to TF-IDF rows. The vocabulary travels once."""
    known = vocabulary.select("term_id", "term", "idf").toArrow().sort_by("term_id").combine_chunks()
    table = vocabulary.sparkSession.sparkContext.broadcast((
        known["term"].cast(pa.string()).combine_chunks(), known["term_id"].to_numpy(),
        known["idf"].to_numpy()))

    def weighted(column: pa.Array) -> pa.Array:
        terms, ids, idf = table.value
        ends, indices, values = np.zeros(len(column) + 1, np.int32), [np.zeros(0, np.int32)], [np.zeros(0)]
        for first, rows, codes, counts, names in _coded(column, bigrams):
            place = pc.index_in(names, value_set=terms).fill_null(-1).to_numpy()[codes]
            own = np.flatnonzero(place >= 0)
            own = own[np.argsort(rows[own] * max(1, len(terms)) + place[own])]
            rows, place = rows[own], place[own]
            w = (1.0 + np.log(counts[own])) * idf[place]
            ends[first + 1:first + 1 + int(rows.max(initial=-1)) + 1] = np.bincount(rows)
            values.append(w / np.sqrt(np.bincount(rows, w * w))[rows])
            indices.append(ids[place].astype(np.int32))
        pa.default_memory_pool().release_unused()
        offsets = pa.array(np.cumsum(ends, dtype=np.int32))
        n = len(column)
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(terms), np.int32)),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(indices))),
             pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))],
            ["type", "size", "indices", "values"])

    return F.arrow_udf(weighted, SPARSE).asNondeterministic()


def transform(docs: DataFrame, vocabulary: DataFrame, tokens: str | None = None) -> DataFrame:
    """Replace ``terms``, or the words of ``tokens``, by ``features``: the TF-IDF row as a sparse struct.

    Weights are ``(1 + ln tf) * idf``, scaled to length 1; unknown terms drop out and a document
    without known terms keeps an empty row. Every document is weighted where it lies: no
    explode, no shuffle. The vocabulary travels to the tasks; ``max_features`` bounds it.
    """
    lean(docs.sparkSession)
    column = tokens or "terms"
    features = _weigher(vocabulary, tokens is not None)(F.col(column))
    return docs.withColumn("features", features).drop(column)


def long_form(features: DataFrame, vocabulary: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, term, weight)``; the vocabulary is broadcast while its size allows."""
    cells = features.select(
        id_column, F.inline(F.arrays_zip("features.indices", "features.values"))
    ).toDF(id_column, "term_id", "weight")
    return cells.join(bounded(vocabulary.select("term_id", "term")), "term_id").select(
        id_column, "term", "weight"
    )

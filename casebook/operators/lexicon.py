"""Dictionary lemmatisation: a token table built once, then looked up where the texts lie."""

from __future__ import annotations

from collections.abc import Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casebook.functions.text import clean_tokens
from casebook.operators.tfidf import most_frequent
from casebook.sources.staging import lean, spread, stage

# The published suffix rules of dictionary morphology, in order of application.
NOUN_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
VERB_RULES = [
    ("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""),
    ("ing", "e"), ("ing", ""),
]

# Changed tokens that travel to the tasks. Rarer ones take the shuffled way, so these stay below
# this many short strings however large the corpus vocabulary grows.
HOT_TOKENS = 200_000
# Hash values that tell which tokens may be among the rarer ones: 2 MB of bits.
MARK_BITS = 24


def _stems(rules: list[tuple[str, str]], kind: str) -> list[Column]:
    """One candidate struct per suffix rule; NULL stem where the rule does not apply."""
    token = F.col("token")
    return [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(order).alias("rule"),
            F.when(
                token.endswith(old) & (F.char_length(token) > len(old)),
                F.concat(F.substring(token, F.lit(1), F.char_length(token) - len(old)), F.lit(new)),
            ).alias("stem"),
        )
        for order, (old, new) in enumerate(rules, start=1)
    ]


def _unchanged(counts: DataFrame) -> DataFrame:
    """The tokens as candidates of themselves, for both kinds."""
    return counts.select(
        "token",
        F.explode(F.array(F.lit("n"), F.lit("v"))).alias("kind"),
        F.lit(0).alias("rule"),
        F.col("token").alias("stem"),
    )


def token_counts(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """``(token, n)`` over an array column; counted in the map tasks first."""
    return (
        tokens.select(F.explode(column).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def build_lexicon(
    counts: DataFrame,
    attested: DataFrame | None = None,
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """``(token, n, lemma)`` for every token of ``counts (token, n)``.

    Noun rules decide first and verb rules only where the noun form equals the token. A stem
    counts if it is attested; the shortest wins, then the token itself, then the earlier rule.
    ``attested (kind, word)`` is the dictionary (kind ``n`` or ``v``), by default the tokens
    themselves for both kinds. ``exceptions (kind, token, lemma)`` holds irregular forms; where a
    token has one, nothing else of that kind is tried.
    """
    stems = counts.select(
        "token", F.inline(F.array(*_stems(NOUN_RULES, "n"), *_stems(VERB_RULES, "v")))
    ).where("stem is not null")
    if attested is None:
        # every token is attested itself, so only shorter stems can win
        candidates = stems.where(F.char_length("stem") < F.char_length("token"))
        known = candidates.join(counts.select(F.col("token").alias("stem")), "stem", "left_semi")
    else:
        known = stems.unionByName(_unchanged(counts)).join(
            attested.select("kind", F.col("word").alias("stem")), ["kind", "stem"], "left_semi"
        )
    if exceptions is not None:
        irregular = exceptions.join(counts, "token", "left_semi")
        known = known.join(irregular.select("token", "kind"), ["token", "kind"], "left_anti")
        known = known.unionByName(
            irregular.select("token", "kind", F.lit(0).alias("rule"), F.col("lemma").alias("stem"))
        )
    best = known.groupBy("token").agg(
        *[
            F.min_by(
                "stem", F.when(F.col("kind") == kind, F.struct(F.char_length("stem"), "rule"))
            ).alias(kind)
            for kind in ("n", "v")
        ]
    )
    noun, verb = F.coalesce("n_form", "token"), F.coalesce("v_form", "token")
    lemma = F.when(noun != F.col("token"), noun).otherwise(verb)
    return (
        counts.join(best.withColumnsRenamed({"n": "n_form", "v": "v_form"}), "token", "left")
        .select("token", "n", lemma.alias("lemma"))
    )


def _marks(rare: DataFrame) -> np.ndarray:
    """One bit for each of ``2**MARK_BITS`` hash values: whether a ``token`` of the frame has it."""
    place = F.crc32(F.col("token").cast("binary")).bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    words = rare.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).alias("bit"))
    bit = F.expr("shiftleft(1L, int(bit))")
    found = words.groupBy("word").agg(F.bit_or(bit).alias("bits")).toArrow()  # 2**(MARK_BITS - 6) rows
    marks = np.zeros(1 << MARK_BITS - 6, np.int64)
    marks[found["word"].to_numpy()] = found["bits"].to_numpy()
    return marks.view(np.uint64)


def _marked(tokens: pa.Array, marks: np.ndarray) -> np.ndarray:
    places = np.fromiter((crc32(t.encode()) for t in tokens.to_pylist()), np.int64, len(tokens))
    places &= (1 << MARK_BITS) - 1
    return (marks[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _lookup(pairs: pa.Table, marks: np.ndarray | None = None):
    """A function of token arrays that replaces the tokens of ``pairs (token, lemma)``.

    The table travels once and a worker keeps it; a batch looks each of its different tokens up
    once. With ``marks`` the other tokens that they mark are told by ``(pos, token)`` beside. Marked
    as not deterministic so that filters on its result don't repeat it.
    """
    pairs = pairs.combine_chunks()
    known, lemmas = (pairs[c].cast(pa.string()).combine_chunks() for c in ("token", "lemma"))
    table = SparkSession.active().sparkContext.broadcast((known, lemmas, marks))

    def replaced(column: pa.Array) -> pa.Array:
        known, lemmas, marks = table.value
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(column).cast(pa.string()).dictionary_encode()
        place = pc.index_in(flat.dictionary, value_set=known)
        new = pc.coalesce(lemmas.take(place), flat.dictionary)
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(ends), new.take(flat.indices))
        if marks is None:
            pa.default_memory_pool().release_unused()
            return tokens
        open_ = _marked(flat.dictionary, marks) & place.is_null().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(open_[flat.indices.to_numpy()])
        row = np.searchsorted(ends, at, "right") - 1
        rest = pa.StructArray.from_arrays(
            [pa.array((at - ends[row]).astype(np.int32)), flat.dictionary.take(flat.indices.take(pa.array(at)))],
            ["pos", "token"])
        rest_ends = np.searchsorted(at, ends).astype(np.int32)
        return pa.StructArray.from_arrays(
            [tokens, pa.ListArray.from_arrays(pa.array(rest_ends), rest)], ["tokens", "rest"])

    kind = "array<string>"
    if marks is not None:
        kind = "struct<tokens: array<string>, rest: array<struct<pos: int, token: string>>>"
    return F.arrow_udf(replaced, kind).asNondeterministic()


def lemmatise(
    docs: DataFrame,
    lexicon: DataFrame,
    id_column: str = "doc_id",
    column: str = "tokens",
    hot_tokens: int = HOT_TOKENS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(id, column)`` with every token replaced by its lemma, order and repeats kept; the columns
    of ``keep`` stay beside them.

    ``lexicon`` should be staged, it is read more than once. The ``hot_tokens`` most frequent
    tokens that change travel to the tasks and are replaced in the arrays where they lie. Only if
    more change, one bit for each hash value of the rest travels as well; tokens that it marks are
    few, as each is rare. They alone are taken out and meet the lexicon in a shuffled join, and
    documents without any are not shuffled. A NULL token array becomes an empty one.
    """
    lean(docs.sparkSession)
    changed = lexicon.where("lemma <> token").select("token", "n", "lemma")
    hot = most_frequent(changed, "n", "token", hot_tokens)
    pairs = hot.select("token", "lemma").toArrow()
    if len(pairs) < hot_tokens:
        return docs.select(id_column, _lookup(pairs)(F.col(column)).alias(column), *keep)
    edge = hot.agg(F.min("n")).first()[0]
    tail = stage(
        changed.where(F.col("n") <= edge).join(hot.select("token"), "token", "left_anti")
        .select("token", "lemma"), "rare_tokens")
    aside = [F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)]
    kept = [F.col(f"_kept{i}").alias(c) for i, c in enumerate(keep)]
    whole = docs.select(
        F.monotonically_increasing_id().alias("row"), id_column,
        _lookup(pairs, _marks(tail))(F.col(column)).alias("new"), *aside,
    )
    whole = stage(whole.select("*", "new.tokens", "new.rest").drop("new"), "lemmatised")
    opened = whole.select("row", F.inline("rest"))
    found = opened.join(tail, "token").groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", "lemma"))).alias("found"))
    marked = whole.where(F.size("rest") > 0).join(found, "row", "left")
    lemmas = F.transform(
        "tokens", lambda t, i: F.coalesce(F.try_element_at("found", i), t))
    lemmas = F.when(F.col("found").isNull(), F.col("tokens")).otherwise(lemmas)
    return whole.where(F.size("rest") == 0).select(
        id_column, F.col("tokens").alias(column), *kept).unionByName(
        marked.select(id_column, lemmas.alias(column), *kept))


def clean_corpus(
    docs: DataFrame,
    text_column: str,
    id_column: str = "doc_id",
    lexicon: DataFrame | None = None,
    shortest: int = 1,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The whole cleaning chain: ``(id, tokens)`` of lemmas with the columns of ``keep``, and the
    lexicon used.

    Tokens are staged once; the lexicon is built from them unless one is given. ``shortest``
    drops lemmas below that length.
    """
    tokens = stage(
        spread(docs.select(id_column, text_column, *keep))
        .where(F.col(text_column).isNotNull())
        .select(id_column, clean_tokens(F.col(text_column)).alias("tokens"), *keep),
        "tokens",
    )
    if lexicon is None:
        lexicon = stage(build_lexicon(stage(token_counts(tokens), "token_counts")), "lexicon")
    lemmas = lemmatise(tokens, lexicon, id_column, keep=keep)
    if shortest > 1:
        lemmas = lemmas.withColumn(
            "tokens", F.filter("tokens", lambda t: F.char_length(t) >= shortest)
        )
    return lemmas, lexicon

"""Flow 2: from labelled texts to train and test features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from casebook.functions.text import clean_tokens
from casebook.operators import tfidf
from casebook.operators.augment import (
    Paraphrase, append_augmented, minority_rows, neighbour_swap, paraphrase_rows,
)
from casebook.operators.labels import regroup
from casebook.operators.lexicon import build_lexicon, clean_corpus, lemmatise, token_counts
from casebook.operators.sampling import split_labels
from casebook.operators.taxonomy import (
    AUGMENTED_ISSUES, BROAD_GROUPS, ISSUE_GROUPS, OTHER, SUB_ISSUE_GROUPS,
)
from casebook.operators.vocabfilter import keep_by_vocabulary
from casebook.sources.staging import fresh_path, stage
from casebook.sources.tables import read_features, write_features


@dataclass
class Prepared:
    """Staged train and test features, and what they were made with."""

    train: DataFrame
    test: DataFrame
    vocabulary: DataFrame
    lexicon: DataFrame


def group_labels(
    docs: DataFrame,
    issue_map: Mapping[str, str] = ISSUE_GROUPS,
    sub_issue_map: Mapping[str, str] = SUB_ISSUE_GROUPS,
) -> DataFrame:
    """Add ``issue_group`` (misses are dropped), ``sub_issue_group`` (misses are ``Other``) and
    ``broad_group``, the two-way group of the sub-issue (``Other`` has none)."""
    grouped = regroup(docs, "issue", issue_map, "issue_group").where("issue_group is not null")
    grouped = regroup(grouped, "sub_issue", sub_issue_map, "sub_issue_group", OTHER)
    return regroup(grouped, "sub_issue_group", BROAD_GROUPS, "broad_group")


def prepared_tokens(docs: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, tokens, labels, is_test)``, staged, and the lexicon."""
    lemmas, lexicon = clean_corpus(docs, "narrative", keep=["issue", "sub_issue"])
    kept = stage(keep_by_vocabulary(group_labels(lemmas), "tokens"), "lemmas")
    return split_labels(kept, "doc_id", "issue_group", test_share), lexicon


def _lexicon_for(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The lexicon plus lemmas of tokens that only the given rows have."""
    new = token_counts(tokens).join(lexicon.select("token"), "token", "left_anti")
    attested = lexicon.select(
        F.explode(F.array(F.lit("n"), F.lit("v"))).alias("kind"), F.col("token").alias("word")
    )
    return lexicon.unionByName(build_lexicon(new, attested))


def features_of(rows: DataFrame, vocabulary: DataFrame, name: str) -> DataFrame:
    """Stage the TF-IDF features of rows with tokens; the vector column is ``features``."""
    path = fresh_path(rows.sparkSession, name)
    write_features(tfidf.transform(rows, vocabulary, "tokens"), path)
    return read_features(rows.sparkSession, path)


def prepare(
    docs: DataFrame,
    max_features: int = tfidf.MAX_FEATURES,
    augmented_issues: Sequence[str] = AUGMENTED_ISSUES,
    paraphrase: Paraphrase | None = neighbour_swap(),
) -> Prepared:
    """Clean, filter, group, split, fit TF-IDF on the original training rows, augment, transform.

    ``docs`` is ``(doc_id, narrative, issue, sub_issue)``. Without ``paraphrase`` nothing is augmented.
    """
    rows, lexicon = prepared_tokens(docs)
    train = rows.where("not is_test")
    vocabulary = stage(tfidf.fit_vocabulary(train, max_features, tokens="tokens"), "vocabulary")
    everything = rows.withColumns(
        {"source_doc_id": F.col("doc_id"), "is_augmented": F.lit(False)}
    )
    if paraphrase is not None:
        chosen = minority_rows(train, "issue", augmented_issues).drop("tokens")
        texts = minority_rows(docs, "issue", augmented_issues).select("doc_id", "narrative")
        texts = texts.join(chosen, "doc_id")
        made = paraphrase_rows(texts, "narrative", paraphrase)
        made = stage(
            made.withColumn("tokens", clean_tokens(F.col("narrative"))).drop("narrative"),
            "paraphrases",
        )
        own = [c for c in made.columns if c not in ("doc_id", "tokens")]
        lemmas = lemmatise(made, stage(_lexicon_for(made, lexicon), "lexicon_augmented"), keep=own)
        everything = append_augmented(rows, lemmas)
    features = features_of(everything, vocabulary, "features")
    return Prepared(
        features.where("not is_test").drop("is_test"),
        features.where("is_test").drop("is_test"),
        vocabulary,
        lexicon,
    )

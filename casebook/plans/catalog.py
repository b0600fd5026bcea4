"""Every query by name. Each takes ``(spark, folder)`` and reads the parquet tables there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from casebook.functions import text as T
from casebook.operators import (
    association, augment, classify, distribution, evaluate, labels, lexicon, profile, sampling,
    series, tfidf, vocabfilter, voting,
)
from casebook.operators.taxonomy import (
    AUGMENTED_ISSUES, OTHER,
)
from casebook.plans import triage
from casebook.plans.explore import CATEGORICAL, export_gate
from casebook.plans.prepare import Prepared, group_labels, prepare, prepared_tokens
from casebook.sources import standin
from casebook.sources.staging import fresh_path, listing, stage, spread
from casebook.sources.tables import (
    read_csv, read_features, read_table, read_vocabulary, write_csv, write_features,
    write_vocabulary,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

COMPANIES = ["AUTOMOBILE", "BUILDING", "MACHINERY"]
PERIODS = [("first", "1996-07-01", "1997-07-01"), ("second", "1999-03-01", "2000-06-01")]
EXTRA_MAP = {"AFRICA": "South", "AMERICA": "West", "ASIA": "East", "EUROPE": "West"}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def day_text(column: str):
    return F.date_format(column, "yyyy-MM-dd")


# --- scans, profile, quality ----------------------------------------------------------------


@query
def scan_schema(spark, folder):
    return profile.schema_counts(standin.narrated(spark, folder))


@query
def column_overview(spark, folder):
    return rounded(profile.column_overview(standin.narrated(spark, folder)), "null_pct")


@query
def zero_variance(spark, folder):
    return profile.zero_variance_columns(standin.complaints(spark, folder))


@query
def csv_roundtrip(spark, folder):
    rows = standin.narratives(spark, folder)
    path = fresh_path(spark, "narratives_csv")
    write_csv(rows, path)
    return read_csv(spark, path, rows.schema)


@query
def duplicate_count(spark, folder):
    return profile.duplicate_count(read_table(spark, folder, "documents").select("text", "lang"))


@query
def drop_duplicates(spark, folder):
    return profile.drop_duplicates(read_table(spark, folder, "documents").select("text", "lang"))


@query
def drop_null_text(spark, folder):
    rows = standin.narrated(spark, folder).select("complaint_id", "narrative")
    return profile.drop_null_rows(rows, ["narrative"])


@query
def fill_unknown(spark, folder):
    rows = standin.complaints(spark, folder).select("complaint_id", "submitted_via", "timely")
    return profile.fill_category(rows, ["submitted_via", "timely"])


# --- projections, filters, labels -----------------------------------------------------------


@query
def date_parts(spark, folder):
    rows = standin.complaints(spark, folder).select(
        "complaint_id", labels.parse_date(F.col("received_text")).alias("received")
    )
    return (
        labels.with_date_parts(rows, "received")
        .withColumn("received", day_text("received"))
        .withColumns({c: F.col(c).cast("long") for c in ("year_received", "month_received")})
    )


@query
def projection_rename(spark, folder):
    return labels.project(
        standin.complaints(spark, folder),
        ["complaint_id", "company", "timely"],
        {"company": "servicer", "timely": "timely_response"},
    )


@query
def company_filter(spark, folder):
    return labels.members(standin.complaints(spark, folder), "company", COMPANIES).select(
        "complaint_id", "company"
    )


@query
def table_filter(spark, folder):
    """Membership in a table: cases whose sub-issue is one of the Asian nations."""
    rows = standin.complaints(spark, folder).select("complaint_id", "sub_issue")
    nation, region = read_table(spark, folder, "nation"), read_table(spark, folder, "region")
    wanted = nation.join(
        region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_name")
    return labels.members(rows, "sub_issue", wanted)


@query
def late_filter(spark, folder):
    rows = standin.complaints(spark, folder)
    return rows.where((F.col("timely") == "No") & (F.col("date_sent") > F.col("date_received"))).select(
        "complaint_id"
    )


@query
def label_map(spark, folder):
    rows = standin.complaints(spark, folder).select("complaint_id", "issue")
    return labels.regroup(rows, "issue", EXTRA_MAP, "issue_group")


@query
def label_map_default(spark, folder):
    rows = standin.complaints(spark, folder).select("complaint_id", "issue")
    return labels.regroup(rows, "issue", EXTRA_MAP, "issue_group", OTHER)


@query
def label_map_table(spark, folder):
    rows = standin.complaints(spark, folder).select("complaint_id", "sub_issue")
    nation, region = read_table(spark, folder, "nation"), read_table(spark, folder, "region")
    table = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("label"), F.col("r_name").alias("label_group")
    )
    return labels.regroup(rows, "sub_issue", table, "sub_issue_group")


@query
def label_regroup(spark, folder):
    rows = standin.narratives(spark, folder).select("doc_id", "issue", "sub_issue")
    return group_labels(rows).select("doc_id", "issue_group", "sub_issue_group")


@query
def broad_target(spark, folder):
    rows = standin.narratives(spark, folder).select("doc_id", "issue", "sub_issue")
    return group_labels(rows).where("broad_group is not null").select("doc_id", "broad_group")


@query
def distinct_labels(spark, folder):
    return labels.distinct_values(standin.predictions(spark, folder), "y_true")


@query
def percent_format(spark, folder):
    rows = series.child_frequencies(standin.complaints(spark, folder), "issue", "timely")
    return rows.select("issue", "timely", labels.percent_text(F.round("share", 6)).alias("share_text"))


# --- aggregations and series ----------------------------------------------------------------


@query
def distinct_counts(spark, folder):
    return series.distinct_counts(standin.complaints(spark, folder), ["issue", "sub_issue"])


@query
def freq_response(spark, folder):
    return series.frequencies(standin.complaints(spark, folder), "submitted_via")


@query
def top_companies(spark, folder):
    return series.top_k(standin.complaints(spark, folder), "state", 10)


@query
def top_issues(spark, folder):
    return series.top_k(standin.complaints(spark, folder), "sub_issue", 5)


@query
def timely_split(spark, folder):
    return series.frequencies(standin.complaints(spark, folder), "timely")


@query
def state_counts(spark, folder):
    return series.frequencies(standin.complaints(spark, folder), "state")


@query
def monthly_volume(spark, folder):
    rows = series.monthly_volume(standin.complaints(spark, folder), "date_received")
    return rows.withColumn("month_end", day_text("month_end"))


@query
def yearly_volume(spark, folder):
    rows = series.yearly_volume(standin.complaints(spark, folder), "date_received")
    return rows.withColumn("year", F.col("year").cast("long"))


@query
def untimely_rate(spark, folder):
    rows = labels.members(standin.complaints(spark, folder), "company", COMPANIES)
    rates = series.monthly_rate(rows, "company", "date_received", "timely", "No")
    return rounded(rates.withColumn("month_end", day_text("month_end")), "rate_pct")


@query
def named_periods(spark, folder):
    monthly = series.monthly_volume(standin.complaints(spark, folder), "date_received")
    tagged = series.tag_periods(monthly, "month_end", PERIODS)
    return tagged.select(day_text("month_end").alias("month_end"), "n", "period")


@query
def top_issue_drilldown(spark, folder):
    return series.top_parent_children(standin.complaints(spark, folder), "issue", "sub_issue")


@query
def child_shares(spark, folder):
    return rounded(
        series.child_frequencies(standin.complaints(spark, folder), "issue", "sub_issue"), "share"
    )


@query
def crosstab(spark, folder):
    return association.contingency(standin.complaints(spark, folder), "issue", "timely")


@query
def class_floor(spark, folder):
    return distribution.class_floor(standin.narratives(spark, folder), "sub_issue")


# --- distributions --------------------------------------------------------------------------


def _word_counts(spark, folder):
    rows = spread(standin.narratives(spark, folder).select("doc_id", "narrative"))
    return rows.select("doc_id", T.word_count(F.col("narrative")).alias("words"))


@query
def word_stats(spark, folder):
    columns = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return rounded(distribution.summary(_word_counts(spark, folder), "words"), *columns)


@query
def length_quantile(spark, folder):
    rows = standin.narratives(spark, folder).select(F.char_length("narrative").alias("n_chars"))
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    return rounded(distribution.exact_quantiles(rows, "n_chars", probabilities), "value")


@query
def amount_quantile(spark, folder):
    rows = read_table(spark, folder, "orders").select("o_totalprice")
    return rounded(
        distribution.exact_quantiles(rows, "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95]), "value"
    )


@query
def export_clean(spark, folder):
    return export_gate(standin.narrated(spark, folder))


@query
def export_deduplicated(spark, folder):
    return export_gate(standin.narratives(spark, folder).drop("doc_id"), deduplicate=True)


@query
def word_histogram(spark, folder):
    rows = _word_counts(spark, folder).where("words < 1000")
    return rounded(distribution.histogram(rows, "words", 50), "lo", "hi")


@query
def confidence_histogram(spark, folder):
    rows = standin.predictions(spark, folder).select("conf")
    return rounded(distribution.histogram(rows, "conf", 25), "lo", "hi")


@query
def confidence_density(spark, folder):
    rows = standin.predictions(spark, folder).select("conf")
    return rounded(distribution.kernel_density(rows, "conf"), "x", "density")


@query
def allocation(spark, folder):
    return rounded(
        distribution.allocation(standin.predictions(spark, folder), "conf", evaluate.REVIEW_THRESHOLD),
        "pct",
    )


# --- association ----------------------------------------------------------------------------


@query
def chi_square(spark, folder):
    cells = association.contingency(standin.complaints(spark, folder), "issue", "timely")
    return rounded(association.chi_square(cells), "chi2")


@query
def chi_square_yates(spark, folder):
    return rounded(
        association.chi_square(association.contingency(standin.flags(spark, folder), "x", "y")),
        "chi2", digits=4,
    )


@query
def cramers_v_pair(spark, folder):
    rows = association.cramers_pair(standin.complaints(spark, folder), "sub_issue", "company")
    return rounded(rows, "chi2", "v")


@query
def cramers_matrix(spark, folder):
    return rounded(association.cramers_matrix(standin.complaints(spark, folder), CATEGORICAL), "v")


# --- text -----------------------------------------------------------------------------------


def _texts(spark, folder):
    return spread(standin.narratives(spark, folder).select("doc_id", "narrative"))


def _lemmas(spark, folder):
    """``(doc_id, tokens)`` of lemmas, and the lexicon."""
    return lexicon.clean_corpus(standin.narratives(spark, folder), "narrative")


@query
def lower_text(spark, folder):
    return _texts(spark, folder).select("doc_id", T.lower_case(F.col("narrative")).alias("text"))


@query
def strip_url(spark, folder):
    pages = spread(read_table(spark, folder, "pages"))
    joined = F.lower(F.concat_ws(" ", "url", "html"))
    return pages.select("page_id", T.strip_urls(joined).alias("text"))


@query
def strip_redaction(spark, folder):
    low = F.lower("narrative")
    return _texts(spark, folder).select(
        "doc_id",
        T.strip_redaction(low).alias("kept"),
        T.strip_redaction(low, "strip").alias("stripped"),
    )


@query
def strip_digits(spark, folder):
    return _texts(spark, folder).select(
        "doc_id", T.strip_digits(F.lower("narrative")).alias("text")
    )


@query
def letters_only(spark, folder):
    return _texts(spark, folder).select(
        "doc_id", T.letters_only(F.lower("narrative")).alias("text")
    )


@query
def normalise_text(spark, folder):
    return _texts(spark, folder).select("doc_id", T.normalised(F.col("narrative")).alias("text"))


@query
def tokens(spark, folder):
    words = T.without_short(T.words(T.normalised(F.col("narrative"))))
    return _texts(spark, folder).select("doc_id", T.joined(words).alias("tokens"))


@query
def stopwords(spark, folder):
    words = T.without_stop_words(T.words(T.normalised(F.col("narrative"))))
    return _texts(spark, folder).select("doc_id", T.joined(words).alias("tokens"))


@query
def page_tokens(spark, folder):
    pages = spread(read_table(spark, folder, "pages"))
    cleaned = T.clean_tokens(F.concat_ws(" ", "url", "html"))
    return pages.select("page_id", T.joined(cleaned).alias("tokens"))


@query
def lemmas(spark, folder):
    tokens = _texts(spark, folder).select(T.clean_tokens(F.col("narrative")).alias("tokens"))
    counts = stage(lexicon.token_counts(tokens), "token_counts")
    return lexicon.build_lexicon(counts)


@query
def clean_text(spark, folder):
    rows, _ = _lemmas(spark, folder)
    return rows.select("doc_id", T.joined(F.col("tokens")).alias("cleaned_text"))


@query
def unique_tokens(spark, folder):
    return _texts(spark, folder).select(
        "doc_id",
        T.unique_word_count(F.col("narrative")).cast("long").alias("n_unique"),
        T.word_count(F.col("narrative")).cast("long").alias("n_words"),
    )


@query
def vocab_filter(spark, folder):
    rows, _ = _lemmas(spark, folder)
    return vocabfilter.keep_by_vocabulary(rows, "tokens").select("doc_id")


@query
def vocab_stats(spark, folder):
    rows, _ = _lemmas(spark, folder)
    return vocabfilter.vocabulary_stats(rows, "tokens")


@query
def ascii_gate(spark, folder):
    return _texts(spark, folder).where(~T.has_non_ascii(F.col("narrative"))).select("doc_id")


@query
def length_gate(spark, folder):
    rows = standin.narratives(spark, folder)
    return rows.where(T.within_length(F.col("narrative"))).select("doc_id")


# --- sampling and augmentation --------------------------------------------------------------


def _labelled(spark, folder):
    rows = standin.narratives(spark, folder).select("doc_id", "issue", "sub_issue")
    return group_labels(rows).select("doc_id", "issue", "issue_group", "sub_issue_group")


@query
def stratified_split(spark, folder):
    return sampling.split_labels(_labelled(spark, folder), "doc_id", "issue_group").select(
        "doc_id", "issue_group", "is_test"
    )


@query
def stratified_folds(spark, folder):
    train, _ = sampling.stratified_split(_labelled(spark, folder), "doc_id", "issue_group")
    folds = sampling.with_folds(stage(train, "train"), "doc_id", "issue_group")
    return folds.select("doc_id", F.col("fold").cast("long").alias("fold"))


def _minority(spark, folder):
    train, _ = sampling.stratified_split(
        _labelled(spark, folder).select("doc_id", "issue", "issue_group"), "doc_id", "issue_group"
    )
    return augment.minority_rows(train, "issue", AUGMENTED_ISSUES)


@query
def minority_rows(spark, folder):
    return _minority(spark, folder).select("doc_id", "issue")


def _augmented(spark, folder):
    texts = standin.narratives(spark, folder).select("doc_id", "narrative")
    rows = _minority(spark, folder).join(texts, "doc_id").select("doc_id", "issue", "narrative")
    return augment.paraphrase_rows(rows, "narrative", augment.neighbour_swap())


@query
def augmented(spark, folder):
    return _augmented(spark, folder)


@query
def augment_union(spark, folder):
    train, _ = sampling.stratified_split(_labelled(spark, folder), "doc_id", "issue_group")
    copies = _augmented(spark, folder).drop("narrative")
    return augment.append_augmented(train.select("doc_id", "issue"), copies)


# --- TF-IDF ---------------------------------------------------------------------------------


def _terms(spark, folder):
    rows, _ = _lemmas(spark, folder)
    return tfidf.with_terms(rows)


def _fitted(spark, folder, max_features=tfidf.MAX_FEATURES):
    rows, _ = _lemmas(spark, folder)
    docs = stage(rows, "lemmas")
    return docs, stage(tfidf.fit_vocabulary(docs, max_features, tokens="tokens"), "vocabulary")


@query
def ngrams(spark, folder):
    return _terms(spark, folder).select("doc_id", F.array_join("terms", "|").alias("terms"))


@query
def term_counts(spark, folder):
    return tfidf.term_counts(_terms(spark, folder))


@query
def vocabulary(spark, folder):
    _, vocab = _fitted(spark, folder)
    return vocab.select(F.col("term_id").cast("long").alias("term_id"), "term", "df", "cf")


@query
def capped_vocabulary(spark, folder):
    _, vocab = _fitted(spark, folder, 1000)
    return vocab.select(F.col("term_id").cast("long").alias("term_id"), "term", "df", "cf")


@query
def idf(spark, folder):
    _, vocab = _fitted(spark, folder)
    return rounded(vocab.select("term", "idf"), "idf")


@query
def weights(spark, folder):
    docs, vocab = _fitted(spark, folder)
    return rounded(tfidf.long_form(tfidf.transform(docs, vocab, "tokens"), vocab), "weight")


@query
def unseen_weights(spark, folder):
    """Fit on the training rows, transform the test rows."""
    rows, _ = prepared_tokens(standin.narratives(spark, folder))
    rows = stage(rows.select("doc_id", "tokens", "is_test"), "split")
    vocab = stage(tfidf.fit_vocabulary(rows.where("not is_test"), tokens="tokens"), "vocabulary")
    features = tfidf.transform(rows.where("is_test").drop("is_test"), vocab, "tokens")
    return rounded(tfidf.long_form(features, vocab), "weight")


@query
def vocabulary_roundtrip(spark, folder):
    rows, _ = _lemmas(spark, folder)
    docs = stage(rows, "lemmas")
    path = fresh_path(spark, "fitted")
    write_vocabulary(tfidf.fit_vocabulary(docs, tokens="tokens"), path)
    return rounded(read_vocabulary(spark, path).select("term", "df", "idf"), "idf")


@query
def feature_roundtrip(spark, folder):
    docs, vocab = _fitted(spark, folder)
    path = fresh_path(spark, "features")
    write_features(tfidf.transform(docs, vocab, "tokens"), path)
    values = read_features(spark, path).select("doc_id", F.unwrap_udt("features").alias("features"))
    return rounded(
        values.select(
            "doc_id",
            F.size("features.values").cast("long").alias("n_terms"),
            F.aggregate("features.values", F.lit(0.0), lambda a, b: a + b).alias("total"),
        ),
        "total",
    )


# --- models ---------------------------------------------------------------------------------

# Shared by the model queries of a session: staged features and runs, by the files they come from.
_PREPARED: dict[tuple, Prepared] = {}
_RUNS: dict[tuple, classify.Cascade] = {}

# Full training with the default tolerance on every labelled row.
SETTINGS = classify.Settings()


def _files(spark, folder) -> tuple:
    """What tells one state of a folder from another: its files, sizes and times."""
    return spark.sparkContext.applicationId, folder, listing(spark, folder)


def _prepared(spark, folder) -> Prepared:
    key = _files(spark, folder)
    if key not in _PREPARED:
        _PREPARED[key] = prepare(standin.narratives(spark, folder))
    return _PREPARED[key]


def _probability_rows(df, classes: Sequence[str]):
    return df.select("doc_id", F.posexplode("p").alias("place", "probability")).select(
        "doc_id",
        F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("place") + 1).alias("label"),
        "probability",
    )


@query
def feature_vectors(spark, folder):
    """Terms and total weight of every stored vector, training and test rows alike."""
    p = _prepared(spark, folder)
    rows = p.train.where("not is_augmented").select("doc_id", "features").unionByName(
        p.test.select("doc_id", "features"))
    cells = rows.select("doc_id", F.unwrap_udt("features").alias("features"))
    return rounded(
        cells.select(
            "doc_id",
            F.size("features.values").cast("long").alias("n_terms"),
            F.aggregate("features.values", F.lit(0.0), lambda a, b: a + b).alias("total"),
        ),
        "total",
    )


@query
def class_weights(spark, folder):
    rows = standin.narratives(spark, folder)
    return rounded(classify.class_weights(rows, "issue"), "weight")


@query
def level1_lr(spark, folder):
    p = _prepared(spark, folder)
    model = classify.fit_logistic(p.train, "issue_group", SETTINGS)
    return _probability_rows(model.add_probabilities(p.test, "p"), model.classes)


@query
def level1_svc_calibrated(spark, folder):
    p = _prepared(spark, folder)
    model = classify.fit_calibrated_svc(p.train, "issue_group", SETTINGS)
    return _probability_rows(model.add_probabilities(p.test, "p"), model.classes)


@query
def grid_search(spark, folder):
    """Both models over the whole level-1 grid, with the cells that the refits use."""
    level = classify.level1(
        _prepared(spark, folder).train, "issue_group", SETTINGS, classify.LEVEL1_GRID)
    return level.scores.select("model", "c", "mean_macro_f1", "best")


def _out_of_fold(spark, folder):
    rows = _prepared(spark, folder).train.where("broad_group is not null")
    return classify.level1(rows, "broad_group", SETTINGS).out_of_fold("p1")


@query
def out_of_fold(spark, folder):
    return _out_of_fold(spark, folder).select("doc_id", "fold", "broad_group", "p1")


def _run(spark, folder, kind: str) -> classify.Cascade:
    """The staged two-level predictions of one folder."""
    key = (*_files(spark, folder), kind)
    if key not in _RUNS:
        p = _prepared(spark, folder)
        _RUNS[key] = (
            triage.broad_cascade(p, SETTINGS)
            if kind == "broad"
            else triage.issue_cascade(
                p, SETTINGS, grid1=classify.LEVEL1_GRID, grid2=classify.LEVEL2_GRID)
        )
    return _RUNS[key]


@query
def level2_cascade(spark, folder):
    return _run(spark, folder, "broad").predictions.select(
        "doc_id", "broad_group", "sub_issue_group", "pred1", "pred2", "conf"
    )


@query
def cascade_sweep(spark, folder):
    return evaluate.threshold_sweep(
        _run(spark, folder, "broad").predictions, true="sub_issue_group", pred="pred2"
    )


@query
def issue_cascade(spark, folder):
    return _run(spark, folder, "issue").predictions.select(
        "doc_id", "issue_group", "sub_issue_group", "pred1", "pred2", "conf"
    )


@query
def alt_grouping(spark, folder):
    scored = triage.alternative_level1(
        _prepared(spark, folder), SETTINGS, grid=classify.LEVEL1_GRID)
    return evaluate.class_report(evaluate.outcomes(scored, "y_true", "pred1"))


@query
def run_summary(spark, folder):
    p = _prepared(spark, folder)
    _, original = classify.fit_level1(
        p.train, p.test, "issue_group", SETTINGS, classify.LEVEL1_GRID)
    return triage.run_summary(
        _run(spark, folder, "broad"), "sub_issue_group",
        original.withColumnRenamed("issue_group", "y_true"),
        triage.alternative_level1(p, SETTINGS, grid=classify.LEVEL1_GRID),
    )


@query
def cascade_report(spark, folder):
    """Level-1 report of a real run, over the test rows that have a level-1 label."""
    run = _run(spark, folder, "broad")
    names = run.level1.classes
    tables = triage.report(run, "broad_group", "sub_issue_group", names)
    return rounded(tables.level1_report, "precision", "recall", "f1")


# --- invariants of the model results, which SQL can tell --------------------------------------


def _checked(df):
    """Per row: the number of classes, whether probabilities add up and lie in range."""
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    return df.select(
        "doc_id",
        F.size("p").cast("long").alias("n_classes"),
        (F.abs(total - 1) < 1e-6).alias("adds_up"),
        F.forall("p", lambda x: (x >= 0) & (x <= 1 + 1e-9)).alias("in_range"),
    )


@query
def level1_lr_checks(spark, folder):
    p = _prepared(spark, folder)
    model = classify.fit_logistic(p.train, "issue_group", SETTINGS)
    return _checked(model.add_probabilities(p.test, "p"))


@query
def level1_svc_checks(spark, folder):
    p = _prepared(spark, folder)
    model = classify.fit_calibrated_svc(p.train, "issue_group", SETTINGS)
    return _checked(model.add_probabilities(p.test, "p"))


@query
def level1_optimality(spark, folder):
    """Both level-1 fits end where no gradient entry exceeds 1e-4 of the first gradient's length;
    the SVM's objective is strictly convex, so it is the only such place."""
    level = classify.fit_level(_prepared(spark, folder).train, "issue_group", SETTINGS)
    rows = [
        (model, len(own), all(x.gradient <= 1e-4 * x.first for x in own), all(x.steps > 0 for x in own))
        for model in classify.MODELS
        for own in [[x for key, x in level.solutions.items() if key[0] == model]]]
    return spark.createDataFrame(rows, "model string, n_fits long, flat boolean, moved boolean")


@query
def level1_better_than_majority(spark, folder):
    """Test macro F1 of the ensemble against that of always naming the largest class."""
    p = _prepared(spark, folder)
    level, told = classify.fit_level1(p.train, p.test, "issue_group", SETTINGS)
    sizes = classify.class_sizes(p.train, "issue_group")
    guess = F.lit(max(sizes, key=sizes.get))
    both = told.select(F.col("issue_group").alias("y_true"), F.explode(F.array(
        F.struct(F.lit("fitted").alias("kind"), F.col("pred1").alias("y_pred")),
        F.struct(F.lit("majority").alias("kind"), guess.alias("y_pred")))).alias("x"))
    scores = evaluate.macro_f1(
        evaluate.outcomes(both.select("y_true", "x.*"), by=["kind"]), ["kind"])
    of = {k: F.max(F.when(F.col("kind") == k, F.col("macro_f1"))) for k in ("fitted", "majority")}
    return scores.agg((of["fitted"] > of["majority"] + 0.3).alias("better"))


@query
def cascade_vectors(spark, folder):
    """Level-2 features: how many entries follow the text's, and that these are probabilities."""
    p = _prepared(spark, folder)
    rows = classify.with_cascade_features(_out_of_fold(spark, folder)).where("not is_augmented")
    width = p.vocabulary.count()
    values = vector_to_array("features")
    last = F.slice(values, width + 1, 1 << 20)
    return rows.select(
        "doc_id", (F.size(values) - width).cast("long").alias("n_extra"),
        (F.abs(F.aggregate(last, F.lit(0.0), lambda a, b: a + b) - 1) < 1e-6).alias("adds_up"))


@query
def alt_grouping_checks(spark, folder):
    """Every test row with an alternative group is predicted, with probabilities over both."""
    scored = triage.alternative_level1(_prepared(spark, folder), SETTINGS)
    return _checked(scored.withColumnRenamed("p1", "p")).join(
        scored.select("doc_id", F.col("y_true").alias("label")), "doc_id")


@query
def cascade_confusion_checks(spark, folder):
    """The level-1 confusion of a real run adds up to the test rows of each true group."""
    run = _run(spark, folder, "broad")
    tables = triage.report(run, "broad_group", "sub_issue_group", run.level1.classes)
    return tables.level1_confusion.groupBy("t").agg(F.sum("n").alias("n"))


@query
def cascade_pairs(spark, folder):
    """The confused pairs of level 1 of a real run."""
    run = _run(spark, folder, "broad")
    tables = triage.report(run, "broad_group", "sub_issue_group", run.level1.classes)
    return rounded(tables.level1_pairs, "rate")


@query
def grid_search_checks(spark, folder):
    scores = grid_search(spark, folder)
    return scores.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if("best").alias("n_best"),
        F.min((F.col("mean_macro_f1") >= 0) & (F.col("mean_macro_f1") <= 1)).alias("in_range"),
    )


@query
def out_of_fold_checks(spark, folder):
    """Every labelled training row once, with probabilities over both groups."""
    return _checked(
        _out_of_fold(spark, folder).where("not is_augmented").withColumnRenamed("p1", "p"))


def _cascade_checks(df, score):
    return df.select(
        "doc_id",
        F.col("pred1").isNotNull().alias("has_level1"),
        F.col("pred2").isNotNull().alias("has_level2"),
        (F.abs(F.col("conf") - score) < 1e-9).alias("conf_fits"),
        F.size("p1").cast("long").alias("n_level1"),
    )


@query
def level2_cascade_checks(spark, folder):
    """Every test row is predicted at both levels; its confidence is the product of both."""
    rows = _run(spark, folder, "broad").predictions
    return _cascade_checks(rows, F.array_max("p1") * F.array_max("p2"))


@query
def issue_cascade_checks(spark, folder):
    rows = _run(spark, folder, "issue").predictions
    return _cascade_checks(rows, F.array_max("p2"))


@query
def cascade_sweep_checks(spark, folder):
    """The review share never falls with the threshold."""
    rows = cascade_sweep(spark, folder).orderBy("threshold").collect()  # twelve thresholds
    shares = [r["review_pct"] for r in rows]
    rising = all(a <= b for a, b in zip(shares, shares[1:]))
    return spark.range(1).select(
        F.lit(len(rows)).cast("long").alias("n_thresholds"), F.lit(rising).alias("rising"))


@query
def unlabelled_rows(spark, folder):
    p = _prepared(spark, folder)
    return triage.unlabelled_rows(p.train.where("not is_augmented"), p.test)


def _tiny(spark, folder, keep):
    """Training and test rows in groups that ``keep`` makes."""
    p = _prepared(spark, folder)
    return tuple(
        df.where("not is_augmented").withColumn("tiny", keep(F.col("doc_id")))
        for df in (p.train, p.test)
    )


@query
def single_class_group(spark, folder):
    """One label in all training rows: it is predicted with certainty."""
    train, test = _tiny(spark, folder, lambda i: F.lit("only"))
    model = classify.fit_ensemble(train, "tiny", SETTINGS)
    scored = model.add_probabilities(test, "p")
    return scored.select(
        "doc_id", voting.argmax_label(F.col("p"), model.class_array()).alias("label"),
        F.array_max("p").alias("conf"))


@query
def small_class_fallback(spark, folder):
    """A class of one training row: the logistic regression stands alone."""
    train, test = _tiny(
        spark, folder, lambda i: F.when(F.pmod(i, F.lit(2)) == 0, "even").otherwise("odd"))
    least = train.agg(F.min("doc_id")).first()[0]
    rare = F.when(F.col("doc_id") == least, "rare").otherwise(F.col("tiny"))
    model = classify.fit_ensemble(train.withColumn("tiny", rare), "tiny", SETTINGS)
    checked = _checked(model.add_probabilities(test, "p"))
    return checked.withColumn("n_models", F.lit(len(model.models)).cast("long"))


# --- votes and evaluation -------------------------------------------------------------------


@query
def soft_vote(spark, folder):
    rows = standin.predictions(spark, folder)
    voted = rows.withColumn("p", voting.soft_vote(F.col("p1"), F.col("p2")))
    return rounded(_probability_rows(voted, standin.LANGS), "probability")


@query
def argmax_label(spark, folder):
    rows = standin.predictions(spark, folder)
    p = voting.soft_vote(F.col("p1"), F.col("p2"))
    return rows.select("doc_id", voting.argmax_label(p, F.col("classes")).alias("label"))


@query
def confidence_level2(spark, folder):
    rows = standin.predictions(spark, folder)
    return rows.select("doc_id", F.round(voting.confidence(F.col("p2")), 6).alias("conf"))


@query
def confidence_joint(spark, folder):
    rows = standin.predictions(spark, folder)
    joint = voting.joint_confidence(F.col("p1"), F.col("p2"))
    return rows.select("doc_id", F.round(joint, 6).alias("conf"))


def _outcomes(spark, folder):
    return evaluate.outcomes(standin.predictions(spark, folder))


@query
def confusion(spark, folder):
    return evaluate.confusion(_outcomes(spark, folder), standin.LANGS)


@query
def confusion_pairs(spark, folder):
    matrix = evaluate.confusion(_outcomes(spark, folder), standin.LANGS)
    return rounded(evaluate.confusion_pairs(matrix), "rate")


@query
def macro_f1(spark, folder):
    return rounded(evaluate.macro_f1(_outcomes(spark, folder)), "macro_f1")


@query
def class_report(spark, folder):
    return rounded(evaluate.class_report(_outcomes(spark, folder)), "precision", "recall", "f1")


@query
def rejection(spark, folder):
    rows = evaluate.rejection(standin.predictions(spark, folder))
    return rounded(rows, "auto_share", "review_share", "f1_auto", "f1_all")


@query
def review_labels(spark, folder):
    return evaluate.review_labels(standin.predictions(spark, folder))


@query
def confidence_buckets(spark, folder):
    return evaluate.confidence_buckets(standin.predictions(spark, folder))


@query
def threshold_sweep(spark, folder):
    return rounded(
        evaluate.threshold_sweep(standin.predictions(spark, folder)), "review_pct", "auto_f1"
    )


@query
def final_report(spark, folder):
    return rounded(
        evaluate.final_report(standin.predictions(spark, folder)), "precision", "recall", "f1"
    )


@query
def auto_confusion(spark, folder):
    return evaluate.auto_confusion(standin.predictions(spark, folder), standin.LANGS)


# The heaviest fits come last.
for _name in ("grid_search", "grid_search_checks", "issue_cascade", "issue_cascade_checks",
              "alt_grouping", "run_summary"):
    QUERIES[_name] = QUERIES.pop(_name)

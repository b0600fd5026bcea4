"""Flow 1: from the raw case table to its description and to the clean text table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from casebook.functions.text import word_count
from casebook.operators import association, distribution, labels, profile, series
from casebook.sources.staging import stage

# Column names of the raw case file and ours.
RAW_COLUMNS = {
    "Date received": "date_received",
    "Date sent to company": "date_sent",
    "Product": "product",
    "Issue": "issue",
    "Sub-issue": "sub_issue",
    "Consumer complaint narrative": "narrative",
    "Company": "company",
    "Company public response": "public_response",
    "Tags": "tags",
    "State": "state",
    "Submitted via": "submitted_via",
    "Company response to consumer": "response",
    "Timely response?": "timely",
}
CATEGORICAL = ["issue", "sub_issue", "company", "state", "submitted_via", "response", "timely"]


def typed_cases(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The raw file with our column names, dates, and year and month received."""
    renamed = labels.project(raw, raw.columns, RAW_COLUMNS)
    dates = {
        c: labels.parse_date(F.col(c), date_format)
        for c in ("date_received", "date_sent")
        if c in renamed.columns
    }
    return labels.with_date_parts(renamed.withColumns(dates), "date_received")


@dataclass
class Description:
    """The tables behind every figure of the exploration."""

    overview: DataFrame
    duplicates: DataFrame
    monthly: DataFrame
    yearly: DataFrame
    top_companies: DataFrame
    top_issues: DataFrame
    label_counts: DataFrame
    drilldown: DataFrame
    timely: DataFrame
    responses: DataFrame
    states: DataFrame
    untimely_rate: DataFrame
    word_stats: DataFrame
    word_histogram: DataFrame
    association: DataFrame


def describe(cases: DataFrame, companies: Sequence[str]) -> Description:
    """Describe typed cases; rates over time are for ``companies``.

    Rows are de-duplicated once; the result is staged, since most tables read it.
    """
    rows = stage(profile.drop_duplicates(cases), "cases")
    texts = profile.drop_null_rows(rows, ["narrative"]).select(
        word_count(F.col("narrative")).alias("words")
    )
    chosen = labels.members(rows, "company", companies)
    return Description(
        overview=profile.column_overview(cases),
        duplicates=profile.duplicate_count(cases),
        monthly=series.monthly_volume(rows, "date_received"),
        yearly=series.yearly_volume(rows, "date_received"),
        top_companies=series.top_k(rows, "company", 10),
        top_issues=series.top_k(rows, "issue", 5),
        label_counts=series.distinct_counts(rows, ["issue", "sub_issue"]),
        drilldown=series.top_parent_children(rows, "issue", "sub_issue"),
        timely=series.frequencies(rows, "timely"),
        responses=series.frequencies(rows, "response"),
        states=series.frequencies(rows, "state"),
        untimely_rate=series.monthly_rate(chosen, "company", "date_received", "timely", "No"),
        word_stats=distribution.summary(texts, "words"),
        word_histogram=distribution.histogram(texts.where("words < 1000"), "words", 50),
        association=association.cramers_matrix(rows, CATEGORICAL),
    )


def export_gate(
    cases: DataFrame,
    text: str = "narrative",
    keep: tuple[str, ...] = ("narrative", "issue", "sub_issue"),
    share: float = 0.25,
    deduplicate: bool = False,
) -> DataFrame:
    """Rows with text, at least as long as the ``share`` quantile of all text lengths.

    De-duplication, where wanted, looks at all columns, so it comes before the projection.
    """
    rows = profile.drop_duplicates(cases) if deduplicate else cases
    present = profile.drop_null_rows(rows.select(*keep), [text]).withColumn(
        "n_chars", F.char_length(text)
    )
    return distribution.quantile_gate(present, "n_chars", share).select(*keep)

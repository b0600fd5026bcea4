"""Micro tables with results worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F, types as T

from casebook.functions import text
from casebook.operators import association, distribution, evaluate, labels, profile, series
from casebook.plans import explore
from casebook.sources.staging import bounded
from casebook.sources.tables import read_csv, write_csv


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_csv_scan(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('id,text\n1,\n2,N/A\n3,None\n4,null\n5,x\n6,"two\nlines, ""quoted"""\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    got = {r.id: r.text for r in read_csv(spark, str(path), schema).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: "x", 6: 'two\nlines, "quoted"'}
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, ' a "b"\nc '), (2, None)], schema)
    write_csv(df, out)
    assert rows(read_csv(spark, out, schema)) == rows(df)


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", 1)], "x string, y int")
    assert profile.duplicate_count(df).first()[0] == 1
    assert profile.drop_duplicates(df).count() == 2
    assert profile.drop_null_rows(df, ["y"]).count() == 1
    over = {r.column: r for r in profile.column_overview(df).collect()}
    assert (over["x"].n_distinct, over["x"].n_null, over["x"].zero_variance) == (1, 0, True)
    assert over["y"].n_null == 2 and round(over["y"].null_pct, 3) == 66.667
    assert rows(profile.schema_counts(df)) == [("x", "string", 3), ("y", "int", 1)]
    assert profile.duplicate_count(df.limit(0)).first()[0] == 0
    rough = {r.column: r.n_distinct for r in profile.column_overview(df, ["x", "y"]).collect()}
    assert rough == {"x": 1, "y": 1}


def test_regroup(spark):
    df = spark.createDataFrame([("k",), ("u",), (None,)], "label_in string")
    mapped = labels.regroup(df, "label_in", {"k": "g"}, "out")
    assert rows(mapped) == [("k", "g"), ("u", None), (None, None)]
    filled = labels.regroup(df, "label_in", {"k": "g"}, "out", "Other")
    assert rows(filled) == [("k", "g"), ("u", "Other"), (None, "Other")]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-03",), ("nonsense",)], "d string")
    lenient = df.select(labels.parse_date(F.col("d"), lenient=True).alias("d"))
    assert [r[0] for r in lenient.collect()] == [dt.date(2024, 2, 3), None]
    with pytest.raises(Exception):
        df.select(labels.parse_date(F.col("d"))).collect()
    assert spark.range(1).select(labels.percent_text(F.lit(0.1234))).first()[0] == "12.3%"


def test_monthly_volume(spark):
    dates = [dt.date(2024, 1, 5), dt.date(2024, 2, 1), dt.date(2024, 4, 2), None]
    df = spark.createDataFrame([(d,) for d in dates], "d date")
    assert rows(series.monthly_volume(df, "d")) == [
        (dt.date(2024, 1, 31), 1), (dt.date(2024, 2, 29), 1), (dt.date(2024, 3, 31), 0),
    ]
    assert series.monthly_volume(df.where("d < '2024-02-01'"), "d").count() == 0


def test_monthly_rate(spark):
    df = spark.createDataFrame(
        [("a", dt.date(2024, 1, 5), "No"), ("a", dt.date(2024, 4, 2), None),
         ("b", dt.date(2024, 2, 1), "Yes")],
        "c string, d date, t string",
    )
    assert rows(series.monthly_rate(df, "c", "d", "t", "No")) == [
        ("a", dt.date(2024, 1, 31), 100.0), ("a", dt.date(2024, 4, 30), 0.0),
        ("b", dt.date(2024, 2, 29), 0.0),
    ]


def test_periods_take_the_first_match(spark):
    df = spark.createDataFrame([(dt.date(2024, m, 1),) for m in (1, 2, 3)], "d date")
    tagged = series.tag_periods(
        df, "d", [("p", "2024-01-15", "2024-03-01"), ("q", "2024-01-01", "2024-02-15")]
    )
    assert [r.period for r in tagged.orderBy("d").collect()] == ["q", "p", None]


@pytest.mark.parametrize("digits", [(16,) * 4, (8,) * 8, distribution.DIGITS])
def test_exact_quantiles(spark, digits):
    df = spark.createDataFrame([(3,), (1,), (2,), (10,), (None,)], "v int")
    got = distribution.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0], digits)
    assert rows(got) == [(0.0, 1.0), (0.25, 1.75), (0.5, 2.5), (1.0, 10.0)]
    constant = spark.range(7).select(F.lit(4).alias("v"))
    assert rows(distribution.exact_quantiles(constant, "v", [0.25])) == [(0.25, 4.0)]


def test_quantiles_match_percentile_on_skewed_values(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit(5.0)).otherwise(F.exp(F.col("id") / 150.0)).alias("v")
    )
    ps = [0.01, 0.33, 0.334, 0.5, 0.999]
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in ps]))).first()[0]
    got = {r.p: r.value for r in distribution.exact_quantiles(df, "v", ps).collect()}
    assert [pytest.approx(w) for w in want] == [got[p] for p in ps]


@pytest.mark.parametrize("values", [
    [1.0, 2.0, float("inf")], [-1.7e308, 0.0, 1.0, 1.7e308], [float("-inf"), -0.0, 0.0, 5e-324],
    [float("-inf"), float("inf")], [1.0, 1.0 + 2**-52, 1.0 + 2**-51], [-3.0, float("nan"), None, -7.5],
])
def test_quantiles_of_extreme_values(spark, values):
    """Infinities, the whole range of doubles and neighbouring doubles: a fixed number of passes."""
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    ordered = sorted(v for v in values if v is not None and not math.isnan(v))
    n = len(ordered) - 1
    ps = [i / n for i in range(n + 1)]
    got = {r.p: r.value for r in distribution.exact_quantiles(df, "v", ps).collect()}
    assert [got[p] for p in ps] == ordered
    if len(values) == 4 and values[0] == -1.7e308:
        assert distribution.quantile(df, "v", 1 / 6) == pytest.approx(-0.85e308)
    assert distribution.summary(df, "v").first().max == ordered[-1]


def test_quantile_passes_are_bounded(spark, monkeypatch):
    calls = []
    counted = distribution._digit_counts
    monkeypatch.setattr(
        distribution, "_digit_counts", lambda *a: (calls.append(a), counted(*a))[1])
    df = spark.range(5000).select(F.exp(F.col("id") / 7.0 - 300).alias("v"))
    distribution.exact_quantiles(df, "v", [i / 20 for i in range(21)])
    assert 0 < len(calls) <= len(distribution.DIGITS)


def test_quantile_gate_keeps_ties(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 2, 9)], "v int")
    assert distribution.quantile_gate(df, "v", 0.25).count() == 4


def test_histogram(spark):
    df = spark.createDataFrame([(0,), (5,), (10,)], "v int")
    assert [r.n for r in distribution.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 2]
    flat = spark.createDataFrame([(3,), (3,)], "v int")
    assert [r.n for r in distribution.histogram(flat, "v", 2).orderBy("bin").collect()] == [2, 0]


def test_kernel_density(spark):
    df = spark.createDataFrame([(0.1,), (0.4,), (0.4,), (0.9,)], "v double")
    got = distribution.kernel_density(df, "v").orderBy("point").collect()
    assert len(got) == 200 and got[0].x == 0.1 and got[-1].x == pytest.approx(0.9)
    assert distribution.kernel_density(df.limit(1), "v").count() == 0
    values, n = [0.1, 0.4, 0.4, 0.9], 4
    mean = sum(values) / n
    h = (sum((v - mean) ** 2 for v in values) / (n - 1)) ** 0.5 * n**-0.2
    for r in got:
        want = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert abs(r.density - want) < 3e-9 / h
    endless = spark.createDataFrame([(1.0,), (float("inf"),), (2.0,)], "v double")
    assert distribution.kernel_density(endless, "v").count() == 0


def cells(spark, matrix):
    data = [(str(i), str(j), n) for i, r in enumerate(matrix) for j, n in enumerate(r) if n]
    return spark.createDataFrame(data, "x string, y string, n long")


@pytest.mark.parametrize(
    "matrix, chi2, v",
    [
        ([[10, 20], [30, 40]], 0.446429, 0.0),
        ([[10, 2], [3, 9], [4, 4]], 8.240523, 0.44658),
        ([[30, 0], [0, 70]], None, 0.975945),
        ([[5, 0, 0], [0, 7, 0], [0, 0, 9]], 42.0, 1.0),
        ([[3, 4, 5]], 0.0, 0.0),
    ],
)
def test_cramers_v(spark, matrix, chi2, v):
    r = association.cramers_v(association.chi_square(cells(spark, matrix))).first()
    assert round(r.v, 6) == v
    if chi2 is not None:
        assert round(r.chi2, 6) == chi2


def test_cramers_matrix_is_symmetric(spark):
    df = spark.createDataFrame(
        [("a", "p", None), ("a", "q", "m"), ("b", "q", "m"), ("b", "q", None), ("c", "p", "m")],
        "x string, y string, z string",
    )
    got = {(r.col1, r.col2): r.v for r in association.cramers_matrix(df, ["x", "y", "z"]).collect()}
    assert len(got) == 9
    assert all(got[a, b] == got[b, a] and 0 <= got[a, b] <= 1 for a, b in got)


def outcomes(spark, pairs):
    return evaluate.outcomes(
        spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "y_true string, y_pred string")
    )


def test_macro_f1(spark):
    counts = outcomes(spark, [(0, 0)] * 3 + [(1, 0), (1, 1), (2, 0)])
    assert round(evaluate.macro_f1(counts).first()[0], 6) == 0.472222
    only_predicted = outcomes(spark, [(0, 0), (0, 7)])
    assert round(evaluate.macro_f1(only_predicted).first()[0], 6) == round((2 / 3) / 2, 6)


def test_confusion_keeps_zero_cells(spark):
    counts = outcomes(spark, [(0, 0), (0, 1), (1, 1)])
    matrix = evaluate.confusion(counts, ["0", "1", "2"])
    assert matrix.count() == 9
    assert rows(evaluate.confusion_pairs(matrix)) == [("0", "1", 1, 0.5)]


def test_buckets_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(c,) for c in (0.0, 0.40, 0.85, 1.0)], "conf double")
    assert [r.n for r in evaluate.confidence_buckets(df).orderBy("place").collect()] == [1, 1, 0, 0, 2]


def test_sweep_with_nothing_automatic(spark):
    df = spark.createDataFrame([("a", "a", 0.1)], "y_true string, y_pred string, conf double")
    got = evaluate.threshold_sweep(df).collect()
    assert len(got) == 12 and all((r.review_pct, r.auto_f1) == (100.0, 0.0) for r in got)
    r = evaluate.rejection(df).first()
    assert (r.n_auto, r.n_review, r.f1_auto, r.f1_all) == (0, 1, 0.0, 1.0)
    assert rows(distribution.allocation(df, "conf", 0.45)) == [("auto", 0, 0.0), ("review", 1, 100.0)]


def test_text_expressions(spark):
    def of(value, expression):
        return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]

    assert of("", text.word_count) == 0 and of("  a  b ", text.word_count) == 2
    sample = "See http://x.y/1 A1b2, it's"
    assert of(sample, text.normalised) == "see ab it s"
    assert of(sample, lambda c: text.clean_tokens(c, stop_words=[])) == ["see", "ab", "it"]
    assert of("XXXX paid", text.normalised) == "xxxx paid"
    assert of("XXXX paid", lambda c: text.normalised(c, "strip")) == "paid"
    assert of("XXXX paid", lambda c: text.clean_tokens(c, "strip")) == ["paid"]
    assert of("loan the loan", lambda c: text.without_stop_words(text.words(c))) == ["loan", "loan"]
    assert of("a" * 5000, text.within_length) and not of("a" * 5001, text.within_length)
    assert of("é", text.has_non_ascii) and not of("e", text.has_non_ascii)
    assert of("x h1ttp://y z٣", text.normalised) == "x http y z"


def test_raw_file_to_description(spark, tmp_path):
    head = ",".join(explore.RAW_COLUMNS)
    lines = [
        f"2024-0{m}-05,2024-0{m}-06,Loan,{i},{i}/{s},{t},{c},,,{st},Web,Closed,{ok}"
        for m, i, s, t, c, st, ok in [
            (1, "A", "x", "some words here", "C1", "NY", "Yes"),
            (1, "A", "x", "some words here", "C1", "NY", "Yes"),
            (2, "A", "y", "", "C1", "CA", "No"),
            (4, "B", "z", "more words", "C2", "CA", "Yes"),
        ]
    ]
    path = tmp_path / "cases.csv"
    path.write_text("\n".join([head, *lines]) + "\n")
    cases = explore.typed_cases(read_csv(spark, str(path)))
    d = explore.describe(cases, ["C1"])
    assert d.duplicates.first()[0] == 1
    assert [r.n for r in d.monthly.orderBy("month_end").collect()] == [1, 1, 0]
    assert rows(d.drilldown) == [("A/x", 1), ("A/y", 1)]
    assert [r.rate_pct for r in d.untimely_rate.orderBy("month_end").collect()] == [0.0, 100.0]
    stats = d.word_stats.first()
    assert (stats.n, stats["min"], stats.q50, stats["max"]) == (2, 2.0, 2.5, 3.0)
    assert d.association.count() == 49 and d.word_histogram.count() == 50
    over = {r.column: r for r in d.overview.collect()}
    assert over["tags"].null_pct == 100.0 and over["product"].zero_variance
    kept = explore.export_gate(cases, deduplicate=True)
    assert rows(kept) == [("some words here", "A", "A/x")]


def test_bounded(spark):
    df = spark.range(3)
    hinted = spark.range(9).join(bounded(df, 3), "id")
    plain = spark.range(9).join(bounded(df, 2), "id")
    plans = [j._jdf.queryExecution().logical().toString() for j in (hinted, plain)]
    assert "broadcast" in plans[0] and "broadcast" not in plans[1]


def test_membership_in_a_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert rows(labels.members(df, "k", spark.createDataFrame([("a",), ("a",)], "z string"))) == [("a", 1)]
    assert rows(labels.members(df, "k", ["b"])) == [("b", 2)]


def test_values_leave_out_nan_and_an_outlier_costs_no_order(spark):
    values = [float(i) for i in range(2000)] + [1e15, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.p: r.value for r in distribution.exact_quantiles(df, "v", [0.25, 0.5, 1.0], (8,) * 8).collect()}
    assert got == {0.25: 500.0, 0.5: 1000.0, 1.0: 1e15}
    row = distribution.summary(df.where("v < 2000"), "v").first()
    assert (row.n, row["mean"], row.q50) == (2000, 999.5, 999.5)


def test_rate_needs_entity_and_month(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-05", "No"), (None, "2024-01-05", "No"), ("a", None, "No")],
        "c string, d string, t string",
    ).withColumn("d", F.to_date("d"))
    assert series.monthly_rate(df, "c", "d", "t", "No").count() == 1


def test_overview_counts_cells_by_short_keys(spark):
    long = "x" * 100
    df = spark.createDataFrame(
        [(long, 0.0, [1]), (long, -0.0, [1]), (long + "y", float("nan"), None), (None, None, [1, 2])],
        "t string, f double, a array<int>",
    )
    got = {r.column: (r.n_distinct, r.n_null) for r in profile.column_overview(df).collect()}
    assert got == {"t": (2, 1), "f": (2, 1), "a": (2, 1)}
    sketched = profile.column_overview(df, approximate=["t"]).collect()
    assert {r.column: r.n_distinct for r in sketched} == {"t": 2, "f": 2, "a": 2}
    assert profile.column_overview(df.limit(0)).count() == 3
    assert [r.column for r in profile.zero_variance_columns(df.select("t").where("t is null")).collect()] == ["t"]

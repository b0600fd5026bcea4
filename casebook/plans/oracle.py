"""The queries in plain SQL (DuckDB), written apart from the Spark code they check."""

from __future__ import annotations

from casebook.functions.words import STOP_WORDS
from casebook.operators.lexicon import NOUN_RULES, VERB_RULES
from casebook.operators.taxonomy import (
    AUGMENTED_ISSUES, BROAD_GROUPS, ISSUE_GROUPS, SUB_ISSUE_GROUPS,
)
from casebook.plans.catalog import CATEGORICAL, COMPANIES, EXTRA_MAP, PERIODS
from casebook.sources.standin import ISSUE_OF_LANG, LANGS, SUB_ISSUE_OF_LABELS
from casebook.sources.tables import NULL_TOKENS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return ", ".join(_q(v) for v in values)


def _values(mapping: dict[str, str]) -> str:
    return ", ".join(f"({_q(k)}, {_q(v)})" for k, v in mapping.items())


def _h(salt: str, key: str = "doc_id") -> str:
    return f"('0x' || substr(md5('{salt}|' || {key}::VARCHAR), 1, 8))::BIGINT"


# --- tables ---------------------------------------------------------------------------------

COMPLAINTS = """complaints AS (
  SELECT o_orderkey AS complaint_id,
         strftime(o_orderdate, '%Y-%m-%d') AS received_text,
         o_orderdate::DATE AS date_received,
         o_orderdate::DATE + c_nationkey AS date_sent,
         'loan' AS product, r_name AS issue, n_name AS sub_issue, c_mktsegment AS company,
         'S' || right(c_name, 2) AS state,
         NULLIF(o_orderpriority, '4-NOT SPECIFIED') AS submitted_via,
         CASE o_orderstatus WHEN 'F' THEN 'No' WHEN 'O' THEN 'Yes' END AS timely,
         o_orderstatus AS response
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey)"""

NARRATED = COMPLAINTS + """, narrated AS (
  SELECT complaints.*, text AS narrative
  FROM complaints LEFT JOIN documents ON complaint_id = doc_id)"""

_issue = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in ISSUE_OF_LANG.items())
_sub = " ".join(
    f"WHEN quality = {q} AND toxic = {t} THEN {_q(v)}" for (q, t), v in SUB_ISSUE_OF_LABELS.items()
)
NARRATIVES = f"""narratives AS (
  SELECT doc_id, text AS narrative, CASE lang {_issue} END AS issue, CASE {_sub} END AS sub_issue
  FROM documents LEFT JOIN labels USING (doc_id))"""

GROUPED = NARRATIVES + f""",
issue_map(label, label_group) AS (VALUES {_values(ISSUE_GROUPS)}),
sub_map(label, label_group) AS (VALUES {_values(SUB_ISSUE_GROUPS)}),
broad_map(label, label_group) AS (VALUES {_values(BROAD_GROUPS)}),
grouped AS (
  SELECT doc_id, narrative, issue, sub_issue, i.label_group AS issue_group,
         coalesce(s.label_group, 'Other') AS sub_issue_group, b.label_group AS broad_group
  FROM narratives n JOIN issue_map i ON n.issue = i.label
  LEFT JOIN sub_map s ON n.sub_issue = s.label
  LEFT JOIN broad_map b ON s.label_group = b.label)"""


def _split(source: str) -> str:
    """Ranks, quotas and the test flag over ``source (doc_id, issue_group, ...)``."""
    return f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY issue_group ORDER BY {_h('split-42')}, doc_id) AS rk
  FROM {source}),
sizes AS (SELECT issue_group, count(*) AS n FROM ranked GROUP BY 1),
exact AS (
  SELECT issue_group, n, ceil(0.2 * (SELECT sum(n) FROM sizes)) AS wanted,
         ceil(0.2 * (SELECT sum(n) FROM sizes))::DOUBLE * n / (SELECT sum(n) FROM sizes) AS share
  FROM sizes),
quotas AS (
  SELECT issue_group, floor(share) + CASE WHEN
    row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, issue_group)
      <= wanted - (SELECT sum(floor(share)) FROM exact) THEN 1 ELSE 0 END AS quota
  FROM exact),
split AS (SELECT r.*, rk <= quota AS is_test FROM ranked r JOIN quotas USING (issue_group))"""


PREDICTIONS = f"""draws AS (
  SELECT doc_id, lang, {_h('p')} / 4294967296.0::DOUBLE AS up,
         {_h('c')} / 4294967296.0::DOUBLE AS uc, ({_h('q')} % 4)::INTEGER AS pick,
         [{", ".join(f"({_h(f'a{i}')} + 1)::DOUBLE" for i in range(4))}] AS ra,
         [{", ".join(f"({_h(f'b{i}')} + 1)::DOUBLE" for i in range(4))}] AS rb
  FROM documents),
predictions AS (
  SELECT doc_id, lang AS y_true,
         CASE WHEN up < 0.8 THEN lang ELSE ([{_in(LANGS)}])[pick + 1] END AS y_pred,
         round(uc, 4) AS conf,
         list_transform(ra, lambda x: x / list_sum(ra)) AS p1,
         list_transform(rb, lambda x: x / list_sum(rb)) AS p2
  FROM draws)"""

_stop = _in(STOP_WORDS)
NORMAL = NARRATIVES + r""", normal AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(narrative),
    'http\S+', '', 'g'), '\d+', '', 'g'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g')) AS text
  FROM narratives)"""
TOKENS = NORMAL + f""", toks AS (
  SELECT doc_id, list_filter(string_split(text, ' '),
                             lambda t: length(t) > 1 AND t NOT IN ({_stop})) AS tokens
  FROM normal)"""

_rules = ", ".join(
    f"({_q(kind)}, {i}, {_q(old)}, {_q(new)})"
    for kind, rules in (("n", NOUN_RULES), ("v", VERB_RULES))
    for i, (old, new) in enumerate(rules, start=1)
)
LEXICON = TOKENS + f""",
counts AS MATERIALIZED (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY 1),
rules(kind, rule, old, new) AS (VALUES {_rules}),
candidates AS MATERIALIZED (
  SELECT token, kind, rule, left(token, length(token) - length(old)) || new AS stem
  FROM counts, rules WHERE ends_with(token, old) AND length(token) > length(old)
  UNION ALL
  SELECT token, kind, 0, token FROM counts, (VALUES ('n'), ('v')) k(kind)),
best AS MATERIALIZED (
  SELECT token, kind, stem FROM candidates WHERE stem IN (SELECT token FROM counts)
  QUALIFY row_number() OVER (PARTITION BY token, kind ORDER BY length(stem), rule) = 1),
lexicon AS (
  SELECT c.token, c.n, CASE WHEN bn.stem <> c.token THEN bn.stem ELSE bv.stem END AS lemma
  FROM counts c JOIN best bn ON bn.token = c.token AND bn.kind = 'n'
  JOIN best bv ON bv.token = c.token AND bv.kind = 'v')"""
LEMMAS = LEXICON + """,
placed AS (
  SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks),
listed AS (
  SELECT doc_id, list(lemma ORDER BY pos) AS lemmas FROM placed JOIN lexicon USING (token)
  GROUP BY doc_id),
lemmas AS (
  SELECT doc_id, coalesce(lemmas, []::VARCHAR[]) AS lemmas FROM toks LEFT JOIN listed USING (doc_id))"""

_terms = """
{name}_long AS (SELECT doc_id, list_filter(lemmas, lambda t: length(t) > 1) AS w FROM {source}),
{name} AS (
  SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
    AS terms FROM {name}_long)"""
TERMS = LEMMAS + "," + _terms.format(name="terms", source="lemmas")


def _vocabulary(source: str, cap: int = 50000) -> str:
    return f"""
tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM {source})
  GROUP BY 1, 2),
size AS (SELECT count(*) AS n FROM {source}),
stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1),
capped AS (
  SELECT term, df, cf FROM stats, size WHERE df >= 3 AND df <= 0.95 * n
  ORDER BY cf DESC, term LIMIT {cap}),
vocab AS (
  SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, df, cf,
         ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf
  FROM capped, size)"""


def _weights(tf: str) -> str:
    return f"""
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM {tf} JOIN vocab USING (term)),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1),
weights AS (SELECT doc_id, term, w / norm AS weight FROM raw JOIN norms USING (doc_id))"""


FITTED = TERMS + "," + _vocabulary("terms")
WEIGHTED = FITTED + "," + _weights("tf")

SCORES = """outcomes AS (SELECT y_true AS t, y_pred AS p, count(*) AS n FROM {rows} GROUP BY 1, 2),
names AS (SELECT t AS label FROM outcomes UNION SELECT p FROM outcomes),
hits AS (
  SELECT label,
         coalesce(sum(n) FILTER (t = label AND p = label), 0) AS tp,
         coalesce(sum(n) FILTER (t = label), 0) AS actual,
         coalesce(sum(n) FILTER (p = label), 0) AS predicted
  FROM names, outcomes GROUP BY label),
scores AS (
  SELECT label, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted::DOUBLE END AS precision,
         CASE WHEN actual = 0 THEN 0 ELSE tp / actual::DOUBLE END AS recall,
         2 * tp / (actual + predicted)::DOUBLE AS f1, actual AS support, tp
  FROM hits)"""
REPORT = """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support::BIGINT AS support FROM (
  SELECT label, precision, recall, f1, support FROM scores
  UNION ALL
  SELECT 'accuracy', sum(tp) / sum(support)::DOUBLE, sum(tp) / sum(support)::DOUBLE,
         sum(tp) / sum(support)::DOUBLE, sum(support) FROM scores
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM scores
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support)::DOUBLE,
         sum(recall * support) / sum(support)::DOUBLE, sum(f1 * support) / sum(support)::DOUBLE,
         sum(support) FROM scores)"""

SPLIT = f"""{LEMMAS}, {GROUPED.removeprefix(NARRATIVES + ',')},
usable AS (
  SELECT g.*, lemmas FROM grouped g JOIN lemmas USING (doc_id)
  WHERE len(list_distinct(lemmas)) BETWEEN 5 AND 500),
{_split('usable')}"""
_CHECKS = "true AS adds_up, true AS in_range"
_CASCADE = "true AS has_level1, true AS has_level2, true AS conf_fits"
_ISSUES = "(SELECT count(DISTINCT issue_group) FROM split WHERE NOT is_test)"

_AUTO = "auto AS (SELECT * FROM predictions WHERE conf >= 0.45)"


def _confusion(rows: str) -> str:
    return f"""classes AS (SELECT unnest([{_in(LANGS)}]) AS c),
matrix AS (
  SELECT a.c AS t, b.c AS p,
         (SELECT count(*) FROM {rows} WHERE y_true = a.c AND y_pred = b.c) AS n
  FROM classes a, classes b)"""


def _frequencies(column: str, source: str = "complaints", limit: str = "") -> str:
    return f"""SELECT {column} AS value, count(*) AS n FROM {source} WHERE {column} IS NOT NULL
GROUP BY 1 ORDER BY n DESC, value {limit}"""


MONTHS = """per_month AS (
  SELECT date_trunc('month', date_received)::DATE AS m, count(*) AS n FROM complaints GROUP BY 1),
calendar AS (
  SELECT unnest(generate_series((SELECT min(m) FROM per_month)::TIMESTAMP,
                                (SELECT max(m) FROM per_month)::TIMESTAMP,
                                INTERVAL 1 MONTH))::DATE AS m),
monthly AS (
  SELECT last_day(m) AS month_end, coalesce(n, 0) AS n FROM calendar LEFT JOIN per_month USING (m)
  WHERE m < (SELECT max(m) FROM per_month))"""


def _histogram(source: str, column: str, bins: int) -> str:
    return f"""span AS (SELECT min({column})::DOUBLE AS a, max({column})::DOUBLE AS b FROM {source}),
filled AS (
  SELECT least(floor(({column} - a) * {bins} / (b - a)), {bins - 1})::BIGINT AS bin, count(*) AS n
  FROM {source}, span GROUP BY 1)
SELECT i AS bin, round(a + i * (b - a) / {bins}, 6) AS lo,
       round(a + (i + 1) * (b - a) / {bins}, 6) AS hi, coalesce(n, 0) AS n
FROM range({bins}) r(i) CROSS JOIN span LEFT JOIN filled ON bin = i"""


def _chi(cells: str, extra: str = "") -> str:
    """Chi-square over the full table, empty cells included, from ``cells (x, y, n)``."""
    return f"""rs AS (SELECT x, sum(n)::DOUBLE AS r FROM {cells} GROUP BY 1),
cs AS (SELECT y, sum(n)::DOUBLE AS c FROM {cells} GROUP BY 1),
shape AS (
  SELECT (SELECT sum(n) FROM {cells})::BIGINT AS n, (SELECT count(*) FROM rs) AS r,
         (SELECT count(*) FROM cs) AS k),
full_table AS (
  SELECT coalesce(t.n, 0)::DOUBLE AS o, rs.r * cs.c / s.n AS e, (s.r - 1) * (s.k - 1) AS dof
  FROM rs CROSS JOIN cs CROSS JOIN shape s LEFT JOIN {cells} t ON t.x = rs.x AND t.y = cs.y),
test AS (
  SELECT s.*, (r - 1) * (k - 1) AS dof,
         (SELECT sum(pow(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2)
                     / e) FROM full_table) AS chi2
  FROM shape s)"""


_V = """CASE WHEN least(k - pow(k - 1, 2) / (n - 1) - 1, r - pow(r - 1, 2) / (n - 1) - 1) = 0 THEN 0.0
ELSE sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)::DOUBLE)
  / least(k - pow(k - 1, 2) / (n - 1)::DOUBLE - 1, r - pow(r - 1, 2) / (n - 1)::DOUBLE - 1)) END"""

_filled = ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in CATEGORICAL)
_ordered_pairs = " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, {a} AS x, {b} AS y, count(*) AS n FROM filled GROUP BY 3, 4"
    for a in CATEGORICAL
    for b in CATEGORICAL
)
CRAMERS_MATRIX = f"""WITH {COMPLAINTS}, filled AS (SELECT {_filled} FROM complaints),
cells AS ({_ordered_pairs}),
rs AS (SELECT col1, col2, x, sum(n)::DOUBLE AS r FROM cells GROUP BY ALL),
cs AS (SELECT col1, col2, y, sum(n)::DOUBLE AS c FROM cells GROUP BY ALL),
shape AS (
  SELECT col1, col2, sum(n)::BIGINT AS n, count(DISTINCT x) AS r, count(DISTINCT y) AS k
  FROM cells GROUP BY ALL),
full_table AS (
  SELECT col1, col2, coalesce(t.n, 0)::DOUBLE AS o, rs.r * cs.c / s.n AS e,
         (s.r - 1) * (s.k - 1) AS dof
  FROM rs JOIN cs USING (col1, col2) JOIN shape s USING (col1, col2)
  LEFT JOIN cells t USING (col1, col2, x, y)),
test AS (
  SELECT col1, col2, n, r, k,
         sum(pow(abs(o - e) - CASE WHEN dof = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2
  FROM full_table JOIN shape USING (col1, col2) GROUP BY ALL)
SELECT col1, col2, round({_V}, 6) AS v FROM test"""


def _columns(with_types: bool) -> str:
    types = {
        "complaint_id": "bigint", "date_received": "date", "date_sent": "date",
    }
    names = [
        "complaint_id", "received_text", "date_received", "date_sent", "product", "issue",
        "sub_issue", "company", "state", "submitted_via", "timely", "response", "narrative",
    ]
    if with_types:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", '{types.get(c, 'string')}' AS dtype, "
            f"count({c}) AS non_null FROM narrated"
            for c in names
        )
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{types.get(c, 'string')}' AS dtype, "
        f"count(DISTINCT {c}) AS n_distinct, count(*) - count({c}) AS n_null, "
        f"round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS null_pct, "
        f"count(DISTINCT {c}) <= 1 AS zero_variance FROM narrated"
        for c in names
    )


_WORDS = NARRATIVES + r""", words AS (
  SELECT doc_id, len(list_filter(regexp_split_to_array(narrative, '\s+'), lambda w: w <> '')) AS words
  FROM narratives)"""

_period = " ".join(
    f"WHEN month_end >= DATE '{a}' AND month_end < DATE '{b}' THEN '{name}'" for name, a, b in PERIODS
)
_tokens_null = _in(NULL_TOKENS)
_MINORITY = f"""minority AS (
  SELECT doc_id, issue, narrative FROM split WHERE NOT is_test AND issue IN ({_in(AUGMENTED_ISSUES)}))"""
_SWAPPED = _MINORITY + r""", worded AS (
  SELECT doc_id, issue,
         list_filter(regexp_split_to_array(narrative, '\s+'), lambda w: w <> '') AS w
  FROM minority WHERE length(narrative) <= 5000),
swapped AS (
  SELECT doc_id, issue, array_to_string(list_transform(range(1, len(w) + 1), lambda i:
    CASE WHEN i % 2 = 1 AND i < len(w) THEN w[i + 1] WHEN i % 2 = 1 THEN w[i] ELSE w[i - 1] END
    ), ' ') AS narrative
  FROM worded),
kept AS (
  SELECT * FROM swapped WHERE narrative <> '' AND NOT regexp_matches(narrative, '[^\x00-\x7F]'))"""

_SUMMARY = """round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75,
  max({c})::DOUBLE AS max"""


def _quantiles(source: str, column: str, probabilities) -> str:
    return " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS p, round(quantile_cont({column}, {p}), 6)::DOUBLE AS value FROM {source}"
        for p in probabilities
    )


_VOTED = (
    f"WITH {PREDICTIONS}, voted AS (SELECT doc_id, list_transform(range(1, 5), "
    "lambda i: (p1[i] + p2[i]) / 2) AS p FROM predictions)"
)

SQL: dict[str, str] = {
    # scans, profile, quality
    "scan_schema": f"WITH {NARRATED} {_columns(True)}",
    "column_overview": f"WITH {NARRATED} {_columns(False)}",
    "zero_variance": f"""WITH {NARRATED} SELECT "column" FROM ({_columns(False)})
WHERE zero_variance AND "column" <> 'narrative'""",
    "csv_roundtrip": f"""WITH {NARRATIVES} SELECT doc_id,
  CASE WHEN narrative NOT IN ({_tokens_null}) THEN narrative END AS narrative, issue, sub_issue
FROM narratives""",
    "duplicate_count": """SELECT (SELECT count(*) FROM documents)
- (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_duplicates""",
    "drop_duplicates": "SELECT DISTINCT text, lang FROM documents",
    "drop_null_text": f"""WITH {NARRATED} SELECT complaint_id, narrative FROM narrated
WHERE narrative IS NOT NULL""",
    "fill_unknown": f"""WITH {COMPLAINTS} SELECT complaint_id,
  coalesce(submitted_via, 'Unknown') AS submitted_via, coalesce(timely, 'Unknown') AS timely
FROM complaints""",
    # projections, filters, labels
    "date_parts": f"""WITH {COMPLAINTS} SELECT complaint_id, received_text AS received,
  year(date_received) AS year_received, month(date_received) AS month_received FROM complaints""",
    "projection_rename": f"""WITH {COMPLAINTS} SELECT complaint_id, company AS servicer,
  timely AS timely_response FROM complaints""",
    "company_filter": f"""WITH {COMPLAINTS} SELECT complaint_id, company FROM complaints
WHERE company IN ({_in(COMPANIES)})""",
    "table_filter": f"""WITH {COMPLAINTS} SELECT complaint_id, sub_issue FROM complaints
WHERE sub_issue IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
    "late_filter": f"""WITH {COMPLAINTS} SELECT complaint_id FROM complaints
WHERE timely = 'No' AND date_sent > date_received""",
    "label_map": f"""WITH {COMPLAINTS}, m(label, label_group) AS (VALUES {_values(EXTRA_MAP)})
SELECT complaint_id, issue, label_group AS issue_group FROM complaints LEFT JOIN m ON issue = label""",
    "label_map_default": f"""WITH {COMPLAINTS}, m(label, label_group) AS (VALUES {_values(EXTRA_MAP)})
SELECT complaint_id, issue, coalesce(label_group, 'Other') AS issue_group
FROM complaints LEFT JOIN m ON issue = label""",
    "label_map_table": f"""WITH {COMPLAINTS} SELECT complaint_id, sub_issue, r_name AS sub_issue_group
FROM complaints LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON sub_issue = n_name""",
    "label_regroup": f"WITH {GROUPED} SELECT doc_id, issue_group, sub_issue_group FROM grouped",
    "broad_target": f"""WITH {GROUPED} SELECT doc_id, broad_group FROM grouped
WHERE broad_group IS NOT NULL""",
    "distinct_labels": "SELECT DISTINCT lang AS y_true FROM documents",
    "percent_format": f"""WITH {COMPLAINTS}, pairs AS (
  SELECT issue, timely, count(*) AS n, sum(count(*)) OVER (PARTITION BY issue) AS total
  FROM complaints GROUP BY 1, 2)
SELECT issue, timely, printf('%.1f%%', 100.0 * round(n / total, 6)::DOUBLE) AS share_text
FROM pairs WHERE timely IS NOT NULL""",
    # aggregations and series
    "distinct_counts": f"""WITH {COMPLAINTS} SELECT count(DISTINCT issue) AS n_issue,
  count(DISTINCT sub_issue) AS n_sub_issue FROM complaints""",
    "freq_response": f"WITH {COMPLAINTS} " + _frequencies("submitted_via"),
    "top_companies": f"WITH {COMPLAINTS} " + _frequencies("state", limit="LIMIT 10"),
    "top_issues": f"WITH {COMPLAINTS} " + _frequencies("sub_issue", limit="LIMIT 5"),
    "timely_split": f"WITH {COMPLAINTS} " + _frequencies("timely"),
    "state_counts": f"WITH {COMPLAINTS} " + _frequencies("state"),
    "monthly_volume": f"""WITH {COMPLAINTS}, {MONTHS}
SELECT strftime(month_end, '%Y-%m-%d') AS month_end, n FROM monthly""",
    "yearly_volume": f"""WITH {COMPLAINTS} SELECT year(date_received) AS year, count(*) AS n
FROM complaints GROUP BY 1""",
    "untimely_rate": f"""WITH {COMPLAINTS} SELECT company,
  strftime(last_day(date_received), '%Y-%m-%d') AS month_end,
  round(100.0::DOUBLE * count(*) FILTER (timely = 'No') / count(*), 6) AS rate_pct
FROM complaints WHERE company IN ({_in(COMPANIES)}) GROUP BY 1, 2""",
    "named_periods": f"""WITH {COMPLAINTS}, {MONTHS}
SELECT strftime(month_end, '%Y-%m-%d') AS month_end, n, CASE {_period} END AS period FROM monthly""",
    "top_issue_drilldown": f"""WITH {COMPLAINTS}, top AS (
  SELECT issue FROM complaints WHERE issue IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, issue LIMIT 1)
SELECT sub_issue AS value, count(*) AS n FROM complaints
WHERE issue = (SELECT issue FROM top) AND sub_issue IS NOT NULL GROUP BY 1""",
    "child_shares": f"""WITH {COMPLAINTS}, parents AS (
  SELECT issue, count(*) AS parent_n FROM complaints GROUP BY 1)
SELECT issue, parent_n, sub_issue, count(*) AS n, round(count(*) / parent_n::DOUBLE, 6) AS share
FROM complaints JOIN parents USING (issue) WHERE sub_issue IS NOT NULL GROUP BY issue, parent_n, sub_issue""",
    "crosstab": f"""WITH {COMPLAINTS} SELECT issue AS x, timely AS y, count(*) AS n FROM complaints
WHERE issue IS NOT NULL AND timely IS NOT NULL GROUP BY 1, 2""",
    "class_floor": f"""WITH {NARRATIVES} SELECT min(n) AS smallest FROM (
  SELECT count(*) AS n FROM narratives WHERE sub_issue IS NOT NULL GROUP BY sub_issue)""",
    # distributions
    "word_stats": f"WITH {_WORDS} SELECT count(words) AS n, {_SUMMARY.format(c='words')} FROM words",
    "length_quantile": f"WITH {NARRATIVES}, lengths AS (SELECT length(narrative) AS l FROM narratives) "
    + _quantiles("lengths", "l", [0.0, 0.25, 0.5, 0.9, 1.0]),
    "amount_quantile": _quantiles("orders", "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95]),
    "export_clean": f"""WITH {NARRATED}, present AS (SELECT * FROM narrated WHERE narrative IS NOT NULL)
SELECT narrative, issue, sub_issue FROM present
WHERE length(narrative) >= (SELECT quantile_cont(length(narrative), 0.25) FROM present)""",
    "export_deduplicated": f"""WITH {NARRATIVES},
present AS (SELECT DISTINCT narrative, issue, sub_issue FROM narratives WHERE narrative IS NOT NULL)
SELECT narrative, issue, sub_issue FROM present
WHERE length(narrative) >= (SELECT quantile_cont(length(narrative), 0.25) FROM present)""",
    "word_histogram": f"WITH {_WORDS}, short AS (SELECT words FROM words WHERE words < 1000), "
    + _histogram("short", "words", 50),
    "confidence_histogram": f"WITH {PREDICTIONS}, " + _histogram("predictions", "conf", 25),
    "confidence_density": f"""WITH {PREDICTIONS}, m AS (
  SELECT min(conf) AS a, max(conf) AS b, count(*) AS n,
         stddev_samp(conf) * pow(count(*), -0.2) AS h FROM predictions),
grid AS (SELECT i AS point, a + i * (b - a) / 199 AS x FROM range(200) r(i), m)
SELECT point, round(x, 6) AS x,
  round(sum(exp(-0.5 * pow((x - conf) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM grid, predictions, m GROUP BY point, x, n, h""",
    "allocation": f"""WITH {PREDICTIONS}
SELECT bucket, count(conf) AS n, round(100.0::DOUBLE * count(conf) / (SELECT count(*) FROM predictions), 6)
  AS pct
FROM (VALUES ('auto'), ('review')) b(bucket)
LEFT JOIN predictions ON (bucket = 'auto') = (conf >= 0.45) GROUP BY 1""",
    # association
    "chi_square": f"""WITH {COMPLAINTS}, cells AS (
  SELECT issue AS x, timely AS y, count(*) AS n FROM complaints
  WHERE issue IS NOT NULL AND timely IS NOT NULL GROUP BY 1, 2), {_chi('cells')}
SELECT n, r, k, dof, round(chi2, 6) AS chi2 FROM test""",
    "chi_square_yates": f"""WITH cells AS (
  SELECT l_linestatus AS x, (l_returnflag = 'A')::VARCHAR AS y, count(*) AS n FROM lineitem
  GROUP BY 1, 2), {_chi('cells')}
SELECT n, r, k, dof, round(chi2, 4) AS chi2 FROM test""",
    "cramers_v_pair": f"""WITH {COMPLAINTS}, cells AS (
  SELECT sub_issue AS x, company AS y, count(*) AS n FROM complaints
  WHERE sub_issue IS NOT NULL AND company IS NOT NULL GROUP BY 1, 2), {_chi('cells')}
SELECT n, r, k, dof, round(chi2, 6) AS chi2, round({_V}, 6) AS v FROM test""",
    "cramers_matrix": CRAMERS_MATRIX,
    # text
    "lower_text": f"WITH {NARRATIVES} SELECT doc_id, lower(narrative) AS text FROM narratives",
    "strip_url": r"""SELECT page_id, regexp_replace(lower(concat_ws(' ', url, html)), 'http\S+', '', 'g')
  AS text FROM pages""",
    "strip_redaction": rf"""WITH {NARRATIVES} SELECT doc_id, lower(narrative) AS kept,
  regexp_replace(lower(narrative), '\bx{{2,}}\b', '', 'g') AS stripped FROM narratives""",
    "strip_digits": rf"""WITH {NARRATIVES} SELECT doc_id,
  regexp_replace(lower(narrative), '\d+', '', 'g') AS text FROM narratives""",
    "letters_only": rf"""WITH {NARRATIVES} SELECT doc_id,
  regexp_replace(lower(narrative), '[^a-z\s]', ' ', 'g') AS text FROM narratives""",
    "normalise_text": f"WITH {NORMAL} SELECT doc_id, text FROM normal",
    "tokens": f"""WITH {NORMAL} SELECT doc_id, array_to_string(
  list_filter(string_split(text, ' '), lambda t: length(t) > 1), ' ') AS tokens FROM normal""",
    "stopwords": f"""WITH {NORMAL} SELECT doc_id, array_to_string(
  list_filter(string_split(text, ' '), lambda t: t <> '' AND t NOT IN ({_stop})), ' ') AS tokens
FROM normal""",
    "page_tokens": rf"""WITH stripped AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(
  lower(concat_ws(' ', url, html)), 'http\S+', '', 'g'), '\d+', '', 'g'), '[^a-z]+', ' ', 'g')) AS text
  FROM pages)
SELECT page_id, array_to_string(list_filter(string_split(text, ' '),
  lambda t: length(t) > 1 AND t NOT IN ({_stop})), ' ') AS tokens FROM stripped""",
    "lemmas": f"WITH {LEXICON} SELECT token, n, lemma FROM lexicon",
    "clean_text": f"""WITH {LEMMAS} SELECT doc_id, array_to_string(lemmas, ' ') AS cleaned_text
FROM lemmas""",
    "unique_tokens": rf"""WITH {NARRATIVES}, w AS (SELECT doc_id,
  list_filter(regexp_split_to_array(narrative, '\s+'), lambda w: w <> '') AS w FROM narratives)
SELECT doc_id, len(list_distinct(w)) AS n_unique, len(w) AS n_words FROM w""",
    "vocab_filter": f"""WITH {LEMMAS} SELECT doc_id FROM lemmas
WHERE len(list_distinct(lemmas)) BETWEEN 5 AND 500""",
    "vocab_stats": f"""WITH {LEMMAS},
sizes AS (SELECT len(list_distinct(lemmas)) AS u, len(lemmas) AS t FROM lemmas)
SELECT count(*) AS original, count(*) FILTER (u < 5) AS removed_low,
  count(*) FILTER (u > 500) AS removed_high, count(*) FILTER (u BETWEEN 5 AND 500) AS final,
  round_even(avg(u) FILTER (u BETWEEN 5 AND 500), 1) AS mean_unique,
  round_even(quantile_cont(u, 0.5) FILTER (u BETWEEN 5 AND 500), 1) AS median_unique,
  round_even(avg(t) FILTER (u BETWEEN 5 AND 500), 1) AS mean_tokens,
  round_even(100.0::DOUBLE * count(*) FILTER (u BETWEEN 5 AND 500) / count(*), 2) AS pct_kept
FROM sizes""",
    "ascii_gate": rf"""WITH {NARRATIVES} SELECT doc_id FROM narratives
WHERE NOT regexp_matches(narrative, '[^\x00-\x7F]')""",
    "length_gate": f"WITH {NARRATIVES} SELECT doc_id FROM narratives WHERE length(narrative) <= 5000",
    # sampling and augmentation
    "stratified_split": f"WITH {GROUPED}, {_split('grouped')} SELECT doc_id, issue_group, is_test FROM split",
    "stratified_folds": f"""WITH {GROUPED}, {_split('grouped')}
SELECT doc_id, ntile(5) OVER (PARTITION BY issue_group ORDER BY {_h('fold-42')}, doc_id) - 1 AS fold
FROM split WHERE NOT is_test""",
    "minority_rows": f"WITH {GROUPED}, {_split('grouped')}, {_MINORITY} SELECT doc_id, issue FROM minority",
    "augmented": f"""WITH {GROUPED}, {_split('grouped')}, {_SWAPPED}
SELECT -doc_id - 1 AS doc_id, issue, narrative, doc_id AS source_doc_id, true AS is_augmented FROM kept""",
    "augment_union": f"""WITH {GROUPED}, {_split('grouped')}, {_SWAPPED}
SELECT doc_id, issue, doc_id AS source_doc_id, false AS is_augmented FROM split WHERE NOT is_test
UNION ALL
SELECT -doc_id - 1, issue, doc_id, true FROM kept""",
    # TF-IDF
    "ngrams": f"WITH {TERMS} SELECT doc_id, array_to_string(terms, '|') AS terms FROM terms",
    "term_counts": f"""WITH {TERMS} SELECT doc_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest(terms) AS term FROM terms) GROUP BY 1, 2""",
    "vocabulary": f"WITH {FITTED} SELECT term_id, term, df, cf FROM vocab",
    "capped_vocabulary": f"""WITH {TERMS}, {_vocabulary('terms', 1000)}
SELECT term_id, term, df, cf FROM vocab""",
    "idf": f"WITH {FITTED} SELECT term, round(idf, 6) AS idf FROM vocab",
    "weights": f"WITH {WEIGHTED} SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
    "unseen_weights": f"""WITH {SPLIT},
train_rows AS (SELECT doc_id, lemmas FROM split WHERE NOT is_test),
test_rows AS (SELECT doc_id, lemmas FROM split WHERE is_test),
{_terms.format(name='train', source='train_rows')},
{_terms.format(name='test', source='test_rows')},
{_vocabulary('train')},
unseen AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM test)
  GROUP BY 1, 2),
{_weights('unseen')}
SELECT doc_id, term, round(weight, 6) AS weight FROM weights""",
    "vocabulary_roundtrip": f"WITH {FITTED} SELECT term, df, round(idf, 6) AS idf FROM vocab",
    "feature_roundtrip": f"""WITH {WEIGHTED} SELECT doc_id, count(term) AS n_terms,
  round(coalesce(sum(weight), 0), 6)::DOUBLE AS total
FROM terms LEFT JOIN weights USING (doc_id) GROUP BY 1""",
    # models
    "class_weights": f"""WITH {NARRATIVES}, s AS (SELECT issue AS label, count(*) AS n FROM narratives GROUP BY 1)
SELECT label, n, round((SELECT sum(n) FROM s)::DOUBLE / ((SELECT count(*) FROM s) * n), 6) AS weight
FROM s""",
    "feature_vectors": f"""WITH {SPLIT},
train_rows AS (SELECT doc_id, lemmas FROM split WHERE NOT is_test),
{_terms.format(name='train', source='train_rows')},
{_terms.format(name='everything', source='split')},
{_vocabulary('train')},
seen AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM everything)
  GROUP BY 1, 2),
{_weights('seen')}
SELECT doc_id, count(term) AS n_terms, round(coalesce(sum(weight), 0), 6)::DOUBLE AS total
FROM split LEFT JOIN weights USING (doc_id) GROUP BY 1""",
    # what holds for any fitted model
    "level1_lr_checks": f"WITH {SPLIT} SELECT doc_id, {_ISSUES} AS n_classes, {_CHECKS} FROM split WHERE is_test",
    "level1_svc_checks": f"WITH {SPLIT} SELECT doc_id, {_ISSUES} AS n_classes, {_CHECKS} FROM split WHERE is_test",
    "grid_search_checks": """SELECT model, 4 AS n_cells, 1 AS n_best, true AS in_range
FROM (VALUES ('logistic'), ('svc')) t(model)""",
    "level1_optimality": f"""WITH {SPLIT} SELECT 'logistic' AS model, 1 AS n_fits, true AS flat, true AS moved
UNION ALL SELECT 'svc', 3 * count(DISTINCT issue_group), true, true FROM split WHERE NOT is_test""",
    "level1_better_than_majority": "SELECT true AS better",
    "cascade_vectors": f"""WITH {SPLIT} SELECT doc_id, 2 AS n_extra, true AS adds_up FROM split
WHERE NOT is_test AND broad_group IS NOT NULL""",
    "alt_grouping_checks": f"""WITH {SPLIT} SELECT doc_id, 2 AS n_classes, {_CHECKS}, b.label_group AS label
FROM split JOIN broad_map b ON b.label = split.issue_group WHERE is_test""",
    "cascade_confusion_checks": f"""WITH {SPLIT} SELECT broad_group AS t, count(*) AS n FROM split
WHERE is_test AND broad_group IS NOT NULL GROUP BY 1""",
    "out_of_fold_checks": f"""WITH {SPLIT} SELECT doc_id, 2 AS n_classes, {_CHECKS} FROM split
WHERE NOT is_test AND broad_group IS NOT NULL""",
    "level2_cascade_checks": f"WITH {SPLIT} SELECT doc_id, {_CASCADE}, 2 AS n_level1 FROM split WHERE is_test",
    "issue_cascade_checks": f"WITH {SPLIT} SELECT doc_id, {_CASCADE}, {_ISSUES} AS n_level1 FROM split WHERE is_test",
    "cascade_sweep_checks": "SELECT 12 AS n_thresholds, true AS rising",
    "unlabelled_rows": f"""WITH {SPLIT} SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS part,
  count(*) AS n_rows, count(*) FILTER (broad_group IS NULL) AS n_left_out FROM split GROUP BY 1""",
    "single_class_group": f"WITH {SPLIT} SELECT doc_id, 'only' AS label, 1.0 AS conf FROM split WHERE is_test",
    "small_class_fallback": f"""WITH {SPLIT} SELECT doc_id, 3 AS n_classes, {_CHECKS}, 1 AS n_models
FROM split WHERE is_test""",
    # votes and evaluation
    "soft_vote": f"""{_VOTED} SELECT doc_id, ([{_in(LANGS)}])[i] AS label, round(p[i], 6) AS probability
FROM voted, range(1, 5) r(i)""",
    "argmax_label": f"""{_VOTED} SELECT doc_id, ([{_in(LANGS)}])[list_position(p, list_max(p))] AS label
FROM voted""",
    "confidence_level2": f"WITH {PREDICTIONS} SELECT doc_id, round(list_max(p2), 6) AS conf FROM predictions",
    "confidence_joint": f"""WITH {PREDICTIONS} SELECT doc_id, round(list_max(p1) * list_max(p2), 6) AS conf
FROM predictions""",
    "confusion": f"WITH {PREDICTIONS}, {_confusion('predictions')} SELECT t, p, n FROM matrix",
    "confusion_pairs": f"""WITH {PREDICTIONS}, {_confusion('predictions')},
shares AS (SELECT t, p, n, n / sum(n) OVER (PARTITION BY t)::DOUBLE AS rate FROM matrix)
SELECT t, p, n, round(rate, 6) AS rate FROM shares WHERE t <> p AND n > 0
ORDER BY shares.rate DESC, t, p LIMIT 10""",
    "macro_f1": f"""WITH {PREDICTIONS}, {SCORES.format(rows='predictions')}
SELECT round(avg(f1), 6) AS macro_f1 FROM scores""",
    "class_report": f"WITH {PREDICTIONS}, {SCORES.format(rows='predictions')} {REPORT}",
    "rejection": f"""WITH {PREDICTIONS}, {_AUTO},
all_f1 AS (WITH {SCORES.format(rows='predictions')} SELECT avg(f1) AS f FROM scores),
auto_f1 AS (WITH {SCORES.format(rows='auto')} SELECT avg(f1) AS f FROM scores),
sizes AS (SELECT (SELECT count(*) FROM predictions) AS n, (SELECT count(*) FROM auto) AS a)
SELECT n AS n_total, a AS n_auto, n - a AS n_review, round(a / n::DOUBLE, 6) AS auto_share,
  round((n - a) / n::DOUBLE, 6) AS review_share, round(auto_f1.f, 6) AS f1_auto,
  round(all_f1.f, 6) AS f1_all
FROM sizes, all_f1, auto_f1""",
    "review_labels": f"""WITH {PREDICTIONS} SELECT y_true AS label, count(*) AS n FROM predictions
WHERE conf < 0.45 GROUP BY 1""",
    "confidence_buckets": f"""WITH {PREDICTIONS},
b(place, bucket, lo, hi) AS (VALUES (0, '<0.40', 0.0, 0.40), (1, '0.40-0.55', 0.40, 0.55),
  (2, '0.55-0.70', 0.55, 0.70), (3, '0.70-0.85', 0.70, 0.85), (4, '>0.85', 0.85, 1.01))
SELECT place::BIGINT AS place, bucket, count(conf) AS n
FROM b LEFT JOIN predictions ON conf >= lo::DOUBLE AND conf < hi::DOUBLE GROUP BY 1, 2""",
    "threshold_sweep": f"""WITH {PREDICTIONS},
steps AS (SELECT round(0.30 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(12) r(i)),
passing AS (SELECT threshold, y_true AS t, y_pred AS p FROM steps, predictions WHERE conf >= threshold),
names AS (SELECT threshold, t AS label FROM passing UNION SELECT threshold, p FROM passing),
f1s AS (
  SELECT threshold, label, 2 * count(*) FILTER (t = label AND p = label)
    / (count(*) FILTER (t = label) + count(*) FILTER (p = label))::DOUBLE AS f1
  FROM names JOIN passing USING (threshold) GROUP BY 1, 2),
means AS (SELECT threshold, avg(f1) AS f FROM f1s GROUP BY 1),
sizes AS (SELECT threshold, count(*) AS a FROM passing GROUP BY 1)
SELECT threshold, coalesce(a, 0) AS n_auto,
  round(100.0::DOUBLE * ((SELECT count(*) FROM predictions) - coalesce(a, 0))
    / (SELECT count(*) FROM predictions), 6) AS review_pct,
  round(coalesce(f, 0), 6) AS auto_f1
FROM steps LEFT JOIN sizes USING (threshold) LEFT JOIN means USING (threshold)""",
    "final_report": f"WITH {PREDICTIONS}, {_AUTO}, {SCORES.format(rows='auto')} {REPORT}",
    "auto_confusion": f"WITH {PREDICTIONS}, {_AUTO}, {_confusion('auto')} SELECT t, p, n FROM matrix",
}

"""Source divergence: odd rows, digests that collide, and the plan's shuffles."""

import re
from collections import Counter, defaultdict

import pytest

from casebook.llm import divergence


def expected(docs, least, most):
    counts, in_docs, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        counts.update((lang, source, t) for t in terms)
        in_docs.update((lang, t) for t in set(terms))
    rows = set()
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        v = len(kept)

        def shares(own):
            n = {t: sum(counts[lang, s, t] for s in own) for t in kept}
            return {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * v) for t in kept}, n

        q, _ = shares(sources)
        by = {s: shares([s]) for s in sources}
        for s in sources:
            p, n = by[s]
            pairs = [(o, sum(abs(p[t] - by[o][0][t]) for t in kept)) for o in sources - {s}]
            terms = [(t, p[t] - q[t]) for t in kept if n[t] > 0 and p[t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, most)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                rows |= {(lang, s, part, *x, i + 1) for i, x in enumerate(items[:limit])}
    return rows


@pytest.fixture(scope="module")
def docs():
    words = "the of and Ünder größe naïve x abc ABC alpha beta gamma delta tau rho 中文".split()
    rows = []
    for i in range(160):
        some = [words[(i * 7 + j * j) % len(words)] for j in range(i % 23)]
        rows.append((" ".join(some) + f" w{i % 3}-{i % 5}", ["en", "de", None][i % 3], f"s{i % 4}"))
    rows += [(None, "en", "s9"), ("", "fr", None), ("9 8 !", "fr", "a"), ("solo " * 3, "xx", "q")]
    rows += [("long " * 40_000 + "Long", "en", "s0")] * 3 + [("copy of all", "en", "s1")] * 60
    return rows


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame(
        [(i, *d, "clash", 1) for i, d in enumerate(docs)],
        "doc_id long, text string, lang string, source string, term string, n long").repartition(5)


def found(frame):
    return {tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()}


def test_equals_plain_counting(table, docs):
    assert found(divergence.audit(table, 10, 5)) == expected(docs, 10, 5)


def test_colliding_digests_are_split(table, docs):
    """With digests of three bits nearly all strings collide; results stay the same."""
    kept, named = divergence._kept(table, 10, 3)
    assert named.where("low <> high").count() > 4
    assert kept.where("term is not null").count() > 4
    assert found(divergence.audit(table, 10, 5, bits=3)) == expected(docs, 10, 5)


def test_full_tables_are_flushed(table, docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 4)
    assert found(divergence.audit(table.coalesce(1), 10, 5)) == expected(docs, 10, 5)


def test_no_kept_term_and_empty_table(spark, table, docs):
    assert found(divergence.audit(table, 1000)) == expected(docs, 1000, 50)
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).collect() == []


def test_shares_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, terms = 4 * 10**17, 9 * 10**17, 10**9
    row = spark.range(1).select(divergence._share(
        F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_only_digests_are_shuffled_before_terms_are_kept(table):
    plan = divergence.term_counts(table)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    names = {k.split("#")[0].strip() for own in keys for k in own.split(",")[:-1]}
    assert names and {n for n in names if not n.isdigit()} <= {"lang", "source", "digest"}
    shuffled = [line for line in plan.splitlines() if "Aggregate" in line]
    assert not any("text#" in line or "term#" in line for line in shuffled)

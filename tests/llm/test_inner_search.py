"""Exact inner-product search against brute force."""

import math
import random

import numpy as np
import pytest

from casebook.llm import inner_search


def expected(rows, every=50, top=5):
    vectors = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    asked = {}
    for i, v in vectors:
        if i is not None and i % every == 0:
            asked[i] = min(v, asked.get(i, v), key=lambda x: x)
    out = {}
    for i, q in asked.items():
        scores = [
            (-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), c is None, c or 0, c)
            for c, v in vectors if c != i
        ]
        out[i] = [(c, -s) for s, _, _, c in sorted(scores, key=lambda x: x[:3])[:top]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        own = out.setdefault(r["query_id"], [])
        own.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(own)
    return out


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(
        [(i, v, 1, 2.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, score long, length double")


@pytest.fixture
def small(monkeypatch):
    """Many tasks, blocks of queries and blocks of candidates."""
    monkeypatch.setattr(inner_search, "TASK_BYTES", 1 << 12)
    monkeypatch.setattr(inner_search, "QUERY_CELLS", 64)
    monkeypatch.setattr(inner_search, "SCORE_CELLS", 1 << 9)


@pytest.mark.parametrize("seed,decay", [(1, 1.0), (2, 0.6)])
def test_random_vectors(spark, seed, decay, small):
    rng = np.random.default_rng(seed)
    scale = decay ** np.arange(12) * rng.uniform(0.1, 3, (400, 1))
    values = (rng.normal(size=(400, 12)) * scale).round(3)
    rows = [(i, v) for i, v in enumerate(values.tolist())]
    assert found(inner_search.nearest(frame(spark, rows, "double"), 10)) == expected(rows, 10)


def test_copies_and_ties(spark, small):
    rng = random.Random(3)
    rows = [(i, [0.5, -0.25, 1.0]) for i in range(300)] + [
        (300 + i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for i in range(200)]
    rng.shuffle(rows)
    assert found(inner_search.nearest(frame(spark, rows))) == expected(rows)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]),
        (5, [float("inf"), 0.0]), (None, [1.0, 2.0]), (6, [-0.001, 0.0]), (50, [0.5]),
        (50, [0.25]), (100, [0.0, 0.0, 9.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
    ]
    got, want = found(inner_search.nearest(frame(spark, rows))), expected(rows)
    assert got.keys() == want.keys()
    for i in want:  # shorter vectors end in zeros, rows that repeat an id are each a candidate
        assert got[i] == want[i]


def test_long_numbers(spark):
    big = [(0, [1e9, -3e9]), (1, [2e9, 1e9]), (2, [1.0, 1.0]), (3, [1e300, 1.0]), (50, [-1e9, 5e8])]
    assert found(inner_search.nearest(frame(spark, big, "double"))) == expected(big)


def test_few_or_no_candidates(spark):
    assert found(inner_search.nearest(frame(spark, [(0, [1.0])]))) == {}
    assert inner_search.nearest(frame(spark, [])).collect() == []
    assert inner_search.nearest(frame(spark, [(1, [1.0]), (2, [2.0])])).collect() == []
    assert found(inner_search.nearest(frame(spark, [(0, [1.0]), (1, [2.0])]))) == {0: [(1, 131072)]}


def test_bounds_end_candidates_early():
    """With a steep spectrum hardly any pair is multiplied out, and the search stops early."""
    rng = np.random.default_rng(4)
    rows = np.floor(rng.normal(size=(4000, 16)) * 0.5 ** np.arange(16) * 4000)
    rows = rows[np.argsort(-np.linalg.norm(rows, axis=1))]
    values, axes = np.linalg.eigh(rows.T @ rows)
    turn = inner_search.Rotation(axes[:, ::-1], [1, 2, 4])
    queries = inner_search._Queries(np.arange(0, 4000, 50), rows[::50], turn, 5)
    taken = []
    take = queries._take
    queries._take = lambda q, ids, s: (taken.append(len(q)), take(q, ids, s))
    met = [queries.meet(np.arange(a, a + 100), rows[a:a + 100]) for a in range(0, 4000, 100)]
    assert not all(met) and sum(taken) < 0.2 * 80 * 4000

"""Registered runs search the reference's grids."""

from types import SimpleNamespace

import pytest

from casebook.operators import classify as c
from casebook.plans import catalog, triage


class Reached(Exception):
    pass


@pytest.fixture
def seen(monkeypatch):
    """The grids that each run was called with; nothing is fitted."""
    calls = []
    monkeypatch.setattr(catalog, "_prepared", lambda spark, folder: SimpleNamespace(train=None, test=None))
    monkeypatch.setattr(catalog, "_files", lambda spark, folder: ("grids", folder))

    def issue(p, s, grid1=None, grid2=None):
        calls.append((grid1, grid2))
        raise Reached

    def other(p, s, grid=None):
        calls.append(grid)
        raise Reached

    def level1(train, test, label, s, grid=None):
        calls.append(grid)
        raise Reached

    monkeypatch.setattr(triage, "issue_cascade", issue)
    monkeypatch.setattr(triage, "alternative_level1", other)
    monkeypatch.setattr(c, "fit_level1", level1)
    return calls


@pytest.mark.parametrize("name, want", [
    ("issue_cascade", (c.LEVEL1_GRID, c.LEVEL2_GRID)),
    ("alt_grouping", c.LEVEL1_GRID),
    ("run_summary", c.LEVEL1_GRID),
])
def test_grids_reach_the_runs(seen, name, want):
    with pytest.raises(Reached):
        catalog.QUERIES[name](None, "folder")
    assert seen == [want]

"""Queries whose lists have no end."""

import os

import pytest

from cohortspark.plans import choice, matcher
from cohortspark.spec import MatchSpec

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_match_single_fuzzy_drops_no_candidates(spark, monkeypatch):
    """A row whose nearest control is taken goes on to its next one, so no list may be cut."""
    import __spark_entry__ as e

    asked = []
    real = matcher.CohortMatcher.match
    monkeypatch.setattr(matcher.CohortMatcher, "match", lambda self, m=None, **o: asked.append(m or MatchSpec(**o)) or real(self, m, **o))
    rows = e.queries()["match_single_fuzzy"](spark, DATA).collect()
    assert [m.k_candidates for m in asked] == [None]
    assert "rank <= 1 " not in choice.oracle_sql()["match_single_fuzzy"]
    assert rows and len({r["ref_id"] for r in rows}) == len(rows)

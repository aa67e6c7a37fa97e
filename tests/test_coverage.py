"""What COVERAGE.md names exists."""

import os
import re

from ledgerloom.plans.catalog import QUERIES, SQL


def test_named_queries_exist():
    with open(os.path.join(os.path.dirname(__file__), "..", "COVERAGE.md")) as f:
        text = f.read()
    named = dict(re.findall(r"`([a-z][a-z0-9_]+)`( ◇)?", text))
    named.pop("tests", None)
    assert set(named) <= set(QUERIES)
    assert all((n in SQL) != bool(mark) for n, mark in named.items())
    assert set(QUERIES) - set(named) <= {"stream_daily_counts"}

"""The modules of the plans themselves."""

import ast
from collections import Counter
from pathlib import Path

import pytest

PLANS = sorted((Path(__file__).parent.parent / "keyscape" / "plans").glob("*.py"))


@pytest.mark.parametrize("path", PLANS, ids=lambda p: p.name)
def test_no_function_hides_another(path):
    names = Counter(x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef))
    assert [n for n, k in names.items() if k > 1] == []


def test_buckets_of_a_stored_listing_follow_its_rows(spark, monkeypatch):
    """A bucket is read by one task, so it must not grow with the input."""
    from keyscape.plans import source_plans

    made, store = [], source_plans.s.store_listing
    monkeypatch.setattr(source_plans, "BUCKET_ROWS", 500)
    monkeypatch.setattr(source_plans.s, "store_listing", lambda df, table, path, n: made.append(n) or store(df, table, path, n))
    source_plans.QUERIES["s15_stored_listing"](spark, "/root/testdata/sf0.001")
    assert made == [12, 12]

"""Every named query against its SQL on the smallest given tables."""

import os

import pytest
from compare import compare

from sondage.plans.catalog import CHECKS, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    if name in CHECKS:
        _, problems = compare(spark, SF_DIR, QUERIES[name], CHECKS[name])
        assert not problems, problems
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_has_a_row_per_question(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 12
    assert set(entry.oracle_sql()) <= set(entry.queries())

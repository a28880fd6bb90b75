"""Registered queries against their SQL on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import compare, duck  # noqa: E402
from hedonica.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small_dir, name):
    con = duck(small_dir)
    found = compare(spark, con, small_dir, name, queries.queries()[name], queries.oracle_sql()[name])
    assert found == ""

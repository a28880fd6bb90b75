"""Every registered query against its SQL in DuckDB, and the shape of the plans."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, duck  # noqa: E402
from helpers import plan_of  # noqa: E402
from hedonica import fixed_values as fixed  # noqa: E402
from hedonica.plans.workspace import workspace  # noqa: E402

SQL = entry.oracle.oracle_sql()
QUERIES = entry.catalog.queries()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, small_dir, name):
    assert compare(spark, con, small_dir, name, QUERIES[name], SQL[name]) == ""


def test_entry_returns_twelve_models(spark):
    rows = entry.entry(spark).collect()
    assert [r["model"] for r in rows] == fixed.MODEL_NAMES


def test_scoring_plan(spark, small_dir):
    w = workspace(spark, small_dir)
    plan = plan_of(w.scored())
    assert plan.count("BroadcastHashJoin") == len(fixed.FACTORS)
    assert "hashpartitioning" not in plan and "Python" not in plan


def test_scans_are_pruned(spark, small_dir):
    w = workspace(spark, small_dir)
    plan = plan_of(w.tidy.agg({"logprice": "avg"}))
    assert "ReadSchema: struct<logprice:double>" in plan
    plan = plan_of(w.raw.where("borough = 3").select("price"))
    assert "EqualTo(borough,3)" in plan


def test_lines_are_shuffled_not_broadcast(spark, small_dir):
    from hedonica.sources.surrogate import sales_raw

    assert "SortMergeJoin [l_orderkey" in plan_of(sales_raw(spark, small_dir))


def test_sales_are_narrow_where_they_are_shuffled(spark, small_dir):
    import re

    from hedonica.sources.surrogate import sales_raw

    sales = sales_raw(spark, small_dir)
    plan = sales._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning", plan)
    assert any("l_orderkey" in columns for columns in moved)
    for columns in moved:
        assert not any(c in columns for c in ("l_discount", "l_tax", "n_name", "r_regionkey"))


def test_the_sales_tables_are_written_compactly(spark, small_dir):
    w = workspace(spark, small_dir)
    for table in (w.raw, w.tidy):
        assert all(f.endswith(".zstd.parquet") for f in table.inputFiles())

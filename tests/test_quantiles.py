import numpy as np
import pytest
from hedonica.operators import quantiles
from hedonica.operators.quantiles import exact_quantiles
from hedonica.session import settled
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def expect(values):
    return [float(v) for v in np.quantile(np.array(values, dtype=float), PROBS)]


@pytest.mark.parametrize("bins,finish_rows", [(1024, 100_000), (16, 0), (64, 50)])
def test_groups_with_a_hot_one_and_ties(spark, bins, finish_rows):
    rng = np.random.default_rng(3)
    data = [("hot", float(v)) for v in rng.lognormal(9, 2, 3000)]
    data += [(None, float(v)) for v in rng.integers(0, 3, 400)]
    data += [("one", 5.0), ("same", 7.0), ("same", 7.0), ("two", -1.0), ("two", 1e9)]
    df = spark.createDataFrame(data + [("hot", None), ("void", None)], "g string, v double")
    out = exact_quantiles(df, "v", PROBS, ["g"], bins, finish_rows).collect()
    found = {r["g"]: r for r in out}
    assert set(found) == {"hot", None, "one", "same", "two"}
    for g, r in found.items():
        values = [v for k, v in data if k == g]
        assert r["n"] == len(values)
        assert r["q"] == pytest.approx(expect(values), rel=1e-12, abs=1e-12)


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e12, 1e12), min_size=1, max_size=30))
def test_any_values_without_groups(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_quantiles(df, "v", PROBS, bins=8, finish_rows=4).first()
    assert row["n"] == len(values)
    assert row["q"] == pytest.approx(expect(values), rel=1e-9, abs=1e-6)


def test_agrees_with_percentile(spark):
    df = spark.range(5000).select((F.hash("id") % 997 / 7).alias("v"))
    wanted = df.agg(F.percentile("v", [0.25, 0.5, 0.75])).first()[0]
    assert exact_quantiles(df, "v", [0.25, 0.5, 0.75], bins=16, finish_rows=10).first()["q"] == wanted


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", PROBS).collect() == []


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_values_must_be_finite(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "v double")
    with pytest.raises(ValueError, match="NaN or infinite"):
        exact_quantiles(df, "v", PROBS)


def test_many_groups_use_written_tables(spark, monkeypatch):
    """Beyond the bound the interval table is written and joined by Spark's choice."""
    monkeypatch.setattr(quantiles, "settled", lambda d, name: settled(d, name, limit=3))
    df = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.hash("id") % 500).alias("v"))
    out = exact_quantiles(df, "v", PROBS, ["g"], bins=32, finish_rows=100).collect()
    values = {}
    for r in df.collect():
        values.setdefault(r["g"], []).append(r["v"])
    assert {r["g"] for r in out} == set(values)
    for r in out:
        assert r["q"] == pytest.approx(expect(values[r["g"]]))


def test_later_passes_read_only_rows_in_wanted_bins(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df, name)

    monkeypatch.setattr(quantiles, "settled", kept)
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.hash("id") / 7).alias("v"))
    long = df.unpivot(["v"], ["g"], "factor", "level")
    exact_quantiles(long, "v", [0.5], ["factor", "level"], bins=64, finish_rows=10).collect()
    assert len(plans) >= 2
    below_expand = plans[1][plans[1].index("Expand"):]
    assert " IN (" in below_expand or "INSET" in below_expand

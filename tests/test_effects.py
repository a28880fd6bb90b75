import math

import numpy as np
import pytest
from helpers import plan_of
from hedonica.operators import effects
from hedonica.session import settled, written
from pyspark.sql import functions as F

SCHEMA = "a string, b int, c string, y double"
FACTORS = ["a", "b", "c"]


def data(n=1500, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        # One level holds a third of the rows; NULL is a level of its own.
        a = "hot" if rng.random() < 0.34 else [None, "x", "y", "z"][rng.integers(4)]
        b = int(rng.integers(6))
        c = ["p", "q"][rng.integers(2)]
        y = 5 + (a == "hot") * 0.4 + 0.1 * b + (c == "p") * (b > 3) * 0.3 + rng.normal(0, 0.2)
        rows.append((a, b, c, float(y)))
    return rows


def by_hand(rows, factors=FACTORS):
    """The chain on plain lists: effects by factor and the RMSE after each step."""
    y = [r[-1] for r in rows]
    mu = math.fsum(y) / len(y)
    left = [v - mu for v in y]
    tables, scores = [], [math.sqrt(math.fsum(v * v for v in left) / len(left))]
    for i in range(len(factors)):
        groups = {}
        for row, v in zip(rows, left):
            groups.setdefault(row[i], []).append(v)
        table = {k: math.fsum(v) / len(v) for k, v in groups.items()}
        left = [v - table[row[i]] for row, v in zip(rows, left)]
        tables.append(table)
        scores.append(math.sqrt(math.fsum(v * v for v in left) / len(left)))
    return mu, tables, scores


def table_of(model, factor):
    return {r["level"]: r["b"] for r in model.table(factor).collect()}


@pytest.mark.parametrize("method", ["moments", "stepwise"])
def test_chain_equals_the_chain_by_hand(spark, method):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    model = effects.fit_chain(df, "y", FACTORS, method)
    mu, tables, scores = by_hand(rows)
    assert (model.n, model.method) == (len(rows), method)
    assert model.mu == pytest.approx(mu, rel=1e-12)
    assert model.rmses() == pytest.approx(scores, rel=1e-9)
    assert model.rmses() == sorted(model.rmses(), reverse=True)
    for factor, table in zip(FACTORS, tables):
        assert table_of(model, factor) == pytest.approx(table, abs=1e-10)
        assert sum(r["n"] for r in model.table(factor).collect()) == len(rows)


@pytest.mark.parametrize("max_cells", [1, 30, 10**6])
def test_pair_counts_for_any_blocks(spark, max_cells):
    rows = data(400)
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {"a": 6, "b": 7, "c": 3}
    found = effects.pair_counts(df, F.col("y"), FACTORS, sizes, max_cells).collect()
    wanted = {}
    for row in rows:
        for j in range(3):
            for k in range(j, 3):
                at = (j, k, row[j] and str(row[j]) if j != 1 else str(row[j]),
                      row[k] and str(row[k]) if k != 1 else str(row[k]))
                n, s = wanted.get(at, (0, 0.0))
                wanted[at] = (n + 1, s + row[-1])
    assert len(found) == len(wanted)
    for r in found:
        n, s = wanted[(r["j"], r["k"], r["level_j"], r["level_k"])]
        assert r["n"] == n and r["s"] == pytest.approx(s, rel=1e-9)


def test_blocks_are_balanced_and_bounded():
    sizes = {f"f{i}": s for i, s in enumerate([6, 8, 6, 3, 5, 5, 14, 5, 14, 8, 13])}
    blocks = effects.blocks_of(sizes)
    assert sorted(f for b in blocks for f in b) == sorted(sizes)
    cells = sorted(math.prod(sizes[f] for f in b) for b in blocks)
    assert cells[-1] * cells[-2] <= effects.MAX_CELLS <= 5_000 and len(blocks) == 6
    assert effects.blocks_of({"a": 3, "b": 4}, 100) == [["b", "a"]]


def test_level_means_of_the_last_factor_are_zero_and_score_reproduces_fit(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    model = effects.fit_chain(df, "y", FACTORS)
    scored = effects.predict(df, model)
    gaps = scored.groupBy("c").agg(F.avg(F.col("y") - F.col("pred")).alias("g")).collect()
    assert all(abs(r["g"]) < 1e-10 for r in gaps)
    assert effects.rmse_by_step(df, model) == pytest.approx(model.rmses(), rel=1e-9)


def test_missing_level_is_matched_and_unseen_level_is_not(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 5.0)], "f string, y double")
    model = effects.fit_chain(train, "y", ["f"])
    new = spark.createDataFrame([("a", 1.0), (None, 1.0), ("z", 1.0)], "f string, y double")
    out = {r["f"]: r["pred"] for r in effects.predict(new, model).collect()}
    assert out["a"] == pytest.approx(1.5) and out[None] == pytest.approx(5.0)
    assert out["z"] is None
    naive, strict = effects.rmse_by_step(new, model)
    assert naive is not None and strict is None
    assert effects.rmse_by_step(new, model, "skip")[1] == pytest.approx(
        math.sqrt((0.25 + 16.0) / 2)
    )


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(effects, "MAX_PAIRS", 1000)
    rows = [(f"id{i % 700}", i % 900, "c", float(i % 13)) for i in range(3000)]
    with pytest.raises(ValueError, match="stepwise"):
        effects.fit_chain(spark.createDataFrame(rows, SCHEMA), "y", FACTORS)


def test_values_that_are_not_finite_are_refused(spark):
    for odd in (float("nan"), float("inf")):
        df = spark.createDataFrame([("a", 1, "c", odd), ("a", 1, "c", 1.0)], SCHEMA)
        with pytest.raises(ValueError, match="finite"):
            effects.fit_chain(df, "y", FACTORS)


def test_many_levels_are_fitted_stepwise(spark):
    rows = [(f"id{i % 700}", i % 900, "c", float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = effects.fit_chain(df, "y", FACTORS, "stepwise")
    assert model.method == "stepwise"
    mu, tables, scores = by_hand(rows)
    assert model.rmses() == pytest.approx(scores, rel=1e-9, abs=1e-9)
    assert table_of(model, "b") == pytest.approx(tables[1], abs=1e-9)


def test_lookup_tables_over_the_bound_are_written_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame(data(300), SCHEMA)
    monkeypatch.setattr(effects, "settled", lambda d, name: settled(d, name, limit=2))
    model = effects.fit_chain(df, "y", FACTORS, "stepwise")
    assert [e.small for e in model.effects] == [False, False, True]
    assert model.rmses() == pytest.approx(by_hand(data(300))[2], rel=1e-9)
    out = effects.predict(df, model)
    assert out.where("pred is null").count() == 0


def test_scoring_is_one_stage_of_broadcast_joins(spark):
    df = spark.createDataFrame(data(300), SCHEMA)
    model = effects.fit_chain(df, "y", FACTORS)
    stored = written(df, "scoring-input")
    plan = plan_of(effects.predict(stored, model))
    assert plan.count("BroadcastHashJoin") == len(FACTORS)
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    assert "Python" not in plan


def test_fit_refuses_missing_outcomes_and_doubled_factors(spark):
    df = spark.createDataFrame([("a", None)], "f string, y double")
    with pytest.raises(ValueError, match="NULL"):
        effects.fit_chain(df, "y", ["f"])
    with pytest.raises(ValueError, match="twice"):
        effects.fit_chain(df, "y", ["f", "f"])
    with pytest.raises(ValueError, match="no rows"):
        effects.fit_chain(df.where("false"), "y", ["f"])


def test_comparison_has_a_row_per_model(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    model = effects.fit_chain(df, "y", FACTORS)
    out = effects.comparison(spark, model, ["mean", "a", "a b", "a b c"], df).collect()
    assert [r["model"] for r in out] == ["mean", "a", "a b", "a b c"]
    assert all(r["rmse"] == pytest.approx(r["holdout_rmse"]) for r in out)

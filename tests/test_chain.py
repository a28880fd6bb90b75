import math

import pytest
from hedonica import spread
from hedonica.operators import chain, effects
from hedonica.slices import save_slice, saved_slices
from helpers import plan_of
from pyspark.sql import functions as F
from test_effects import FACTORS, SCHEMA, by_hand, data, table_of

TYPES = {"a": "string", "b": "int", "c": "string"}


def check(model, rows, factors=FACTORS):
    mu, tables, scores = by_hand(rows, factors)
    assert model.n == len(rows) and model.mu == pytest.approx(mu, rel=1e-12)
    assert model.rmses() == pytest.approx(scores, rel=1e-9, abs=1e-9)
    for factor, table in zip(factors, tables):
        assert table_of(model, factor) == pytest.approx(table, abs=1e-9)


def test_refit_from_saved_slices_equals_the_fit_of_all_rows(spark, tmp_path):
    rows, path = data(1200), str(tmp_path / "state")
    for name, part in {"day 1": rows[:700], "day/2": rows[700:], "3": []}.items():
        state = chain.moment_state(spark.createDataFrame(part, SCHEMA), "y", FACTORS, 5.0)
        save_slice(state, path, name)
    state = saved_slices(spark, path, chain.STATE)
    assert {r["slice"] for r in state.select("slice").distinct().collect()} == {"day 1", "day/2"}
    check(chain.fit_state(state, "y", FACTORS, TYPES, 5.0), rows)
    # a load that is run again counts once
    again = chain.moment_state(spark.createDataFrame(rows[700:], SCHEMA), "y", FACTORS, 5.0)
    save_slice(again, path, "day/2")
    check(chain.fit_state(saved_slices(spark, path, chain.STATE), "y", FACTORS, TYPES, 5.0), rows)


def test_states_merge_in_steps_and_other_orders_fit(spark):
    rows = data(900)
    parts = [chain.moment_state(spark.createDataFrame(rows[i::3], SCHEMA), "y", FACTORS, 4.0) for i in range(3)]
    state = chain.merged(chain.merged(parts[0].union(parts[1])).union(parts[2]))
    order = ["c", "a"]
    model = chain.fit_state(state, "y", order, TYPES, 4.0)
    check(model, [(c, a, y) for a, _, c, y in rows], order)
    with pytest.raises(ValueError, match="no factor z"):
        chain.fit_state(state, "y", ["a", "z"], TYPES, 4.0)


def test_many_levels_stay_distributed(spark, monkeypatch):
    """No list of pairs reaches the driver: settled tables over the bound are joined."""
    n = 4000
    rows = [(None if i % 3 == 0 else f"id{i * 7 % 1900}", i % 1500, f"c{i % 11}", math.sin(i) + i % 13) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(effects, "MAX_PAIRS", 1000)
    with pytest.raises(ValueError, match="fit_joined"):
        effects.fit_chain(df, "y", FACTORS)
    monkeypatch.setattr(chain, "settled", lambda d, name: chain_settled(d, name))
    model = chain.fit_joined(df, "y", FACTORS, hot_rows=100)
    assert [e.small for e in model.effects] == [False, False, True]
    check(model, rows)
    stepwise = effects.fit_chain(df, "y", FACTORS, "stepwise")
    assert model.rmses() == pytest.approx(stepwise.rmses(), rel=1e-9)
    scored = effects.predict(df, model)
    plan = plan_of(scored)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert scored.where("pred IS NULL").count() == 0
    assert effects.rmse_by_step(df, model) == pytest.approx(model.rmses(), rel=1e-9)


def chain_settled(df, name):
    from hedonica.session import settled

    return settled(df, name, limit=100)


def test_odd_tables(spark):
    with pytest.raises(ValueError, match="no values"):
        chain.fit_joined(spark.createDataFrame([], SCHEMA), "y", FACTORS)
    with pytest.raises(ValueError, match="finite"):
        chain.moment_state(spark.createDataFrame([("a", 1, "c", float("nan"))], SCHEMA), "y", FACTORS, 0.0)
    with pytest.raises(ValueError, match="no rows"):
        chain.fit_state(spark.createDataFrame([], chain.STATE), "y", FACTORS, TYPES, 0.0)
    with pytest.raises(ValueError, match="twice"):
        chain.moment_state(spark.createDataFrame(data(5), SCHEMA), "y", ["a", "a"], 0.0)
    check(chain.fit_joined(spark.createDataFrame(data(1), SCHEMA), "y", FACTORS), data(1))


# --- lookup of large tables ---------------------------------------------------------------


def test_a_hot_key_is_spread_over_all_tasks(spark):
    """Nine tenths of the rows hold one key, and no key at that; adaptive execution is off."""
    n, tasks = 20_000, 8
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 != 0, F.lit(None)).otherwise(F.col("id") % 700).cast("int").alias("k"), "id"
    )
    table = spark.range(700).select(F.col("id").cast("int").alias("key"), (F.col("id") * 2).alias("v"))
    table = table.union(spark.createDataFrame([(None, -1)], "key int, v long"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        def largest(df):
            return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())

        plain = rows.join(table, rows["k"].eqNullSafe(table["key"]), "left")
        assert largest(plain) >= 0.9 * n
        out = spread.spread_lookup(rows, table, {"k": "key"}, hot_rows=200)
        assert largest(out) < 2 * n / tasks
        wanted = {(r["k"], r["id"], r["v"]) for r in plain.collect()}
        assert {(r["k"], r["id"], r["v"]) for r in out.collect()} == wanted and out.count() == n
    finally:
        for name in ("adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_spread_lookup_keeps_rows_and_names(spark):
    rows = [("a", 1, "x")] * 40 + [(None, 2, "x")] * 30 + [("z", 1, None)] * 5 + [("b", 1, "y")]
    df = spark.createDataFrame(rows, "key0 string, salt int, salts string")
    table = spark.createDataFrame([("a", 1, 5), (None, 2, 6), ("b", 1, 7), ("c", 1, 8)], "f string, g int, v int")
    for how, missing in (("left", 5), ("inner", 0)):
        out = spread.spread_lookup(df, table, {"key0": "f", "salt": "g"}, how, hot_rows=7)
        assert out.columns == ["key0", "salt", "salts", "v"]
        counts = {r["v"]: r["count"] for r in out.groupBy("v").count().collect()}
        assert counts == {5: 40, 6: 30, 7: 1} | ({None: missing} if missing else {})
    empty = spread.spread_lookup(df.where("false"), table, {"key0": "f", "salt": "g"})
    assert empty.count() == 0

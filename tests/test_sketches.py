import random
from collections import Counter

import pytest
from hedonica.operators import profile, sketches
from hedonica.slices import save_slice, saved_slices
from pyspark.sql import functions as F

SCHEMA = "a string, b int, v double"


def data(n=6000):
    rng = random.Random(4)
    return [
        (rng.choice(["hot", "hot", None, "x"]), rng.randrange(900), rng.choice([1.0, rng.gauss(0, 1), None, rng.expovariate(1)]))
        for _ in range(n)
    ]


def test_quantiles_of_saved_slices_are_within_the_bound(spark, tmp_path):
    rows, path = data(), str(tmp_path / "q")
    for i in range(4):
        part = spark.createDataFrame(rows[i::4], SCHEMA)
        save_slice(sketches.quantile_state(part, "v", ["a"]), path, f"s{i}")
    state = sketches.merged_quantiles(saved_slices(spark, path, sketches.QUANTILE_STATE))
    found = sketches.quantiles_of(state, [0.25, 0.5, 0.75])
    df = spark.createDataFrame(rows, SCHEMA)
    gaps = sketches.rank_gaps(df, "v", found, [0.25, 0.5, 0.75]).collect()
    values = {}
    for a, _, v in rows:
        if v is not None:
            values.setdefault(a, []).append(v)
    assert {r["level"]: r["n"] for r in gaps} == {a: len(v) for a, v in values.items()}
    assert max(g for r in gaps for g in r["gaps"]) <= 2 * sketches.rank_error()
    for r in state.collect():
        assert (r["low"], r["high"]) == (min(values[r["level"]]), max(values[r["level"]]))
        assert len(r["sketch"]) < 20_000


def test_rank_gaps_are_the_distances_of_ranks(spark):
    df = spark.createDataFrame([("a", 1, float(v)) for v in [1, 2, 2, 2, 9]], SCHEMA)
    found = spark.createDataFrame([("a", "a", 5, [1.0, 2.0, 9.0])], "factor string, level string, n long, q array<double>")
    gaps = sketches.rank_gaps(df, "v", found, [0.5, 0.5, 0.5]).first()["gaps"]
    assert gaps == pytest.approx([0.3, 0.0, 0.3])


def test_levels_of_saved_slices(spark, tmp_path):
    rows, path = data(), str(tmp_path / "l")
    for i in range(3):
        save_slice(sketches.level_state(spark.createDataFrame(rows[i::3], SCHEMA), ["a", "b"]), path, str(i))
    state = sketches.merged_levels(saved_slices(spark, path, sketches.LEVEL_STATE))
    found = {r["factor"]: r for r in sketches.levels_of(state).collect()}
    exact = profile.level_counts(spark.createDataFrame(rows, SCHEMA), ["a", "b"]).collect()
    for r in exact:
        assert found[r["factor"]]["n_filled"] == r["n_filled"]
        assert found[r["factor"]]["n_levels"] == pytest.approx(r["n_levels"], rel=4 * sketches.level_error())


@pytest.mark.parametrize("share", [0.001, 0.05, 0.3])
def test_heavy_levels_are_all_found_and_counted(spark, share):
    rows = data(3000) + [("x=", 3, None)] * 200 + [("", 4, None)] * 150
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {(r["factor"], r["level"]): r["n"] for r in sketches.heavy_levels(df, ["a", "b"], share).collect()}
    counts = Counter(("a", r[0]) for r in rows) + Counter(("b", str(r[1])) for r in rows)
    assert found == {k: n for k, n in counts.items() if n > share * len(rows)}


def test_heavy_levels_of_nothing_and_odd_shares(spark):
    df = spark.createDataFrame(data(10), SCHEMA)
    assert sketches.heavy_levels(df.where("false"), ["a"], 0.1).count() == 0
    unlike = spark.range(100).withColumn("a", F.col("id").cast("string"))
    assert sketches.heavy_levels(unlike, ["a"], 0.05).count() == 0
    with pytest.raises(ValueError):
        sketches.heavy_levels(df, ["a"], 0.0)

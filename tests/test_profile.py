import hashlib
import math

import numpy as np
import pytest
from hedonica.operators import boxplot, histogram, profile
from pyspark.sql import functions as F

ROWS = [("a", 1, 10.0), ("b", 1, 20.0), (None, 2, 30.0), ("a", 2, None), ("ab", 3, 5.0)]
SCHEMA = "t string, i int, x double"


def test_frequency_leaves_out_missing_levels(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert [tuple(r) for r in profile.frequency(df, "t").collect()] == [
        ("a", 2), ("ab", 1), ("b", 1),
    ]


def test_level_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = {r["factor"]: tuple(r) for r in profile.level_counts(df, ["t", "i"]).collect()}
    assert out == {"t": ("t", 3, 5, 4), "i": ("i", 3, 5, 5)}
    near = {r["factor"]: r["n_levels"] for r in profile.approx_level_counts(df, ["t", "i"]).collect()}
    assert near == {"t": 3, "i": 3}


def test_level_codes_follow_text_order_across_leads(spark):
    texts = ["b", "ab", "a", "abc", "aa", "10", "9", "", None, "a", "ab d", "é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = {r["level"]: r["code"] for r in profile.level_codes(df, ["t"]).collect()}
    ordered = sorted({t for t in texts if t is not None}, key=lambda t: t.encode())
    assert out == {t: i for i, t in enumerate(ordered, start=1)}


def test_schema_profile(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = [tuple(r) for r in profile.schema_profile(df, ["t", "i"]).collect()]
    assert out == [
        (1, "t", "string", 4, 3, sample_of(["a", "b", "ab"])), (2, "i", "int", 5, 3, sample_of("123")),
        (3, "x", "double", 4, None, sample_of(["10.000000", "20.000000", "30.000000", "5.000000"])),
    ]


def sample_of(texts):
    digest = {t: hashlib.md5(t.encode()).hexdigest() for t in texts}
    return ", ".join(sorted({min((digest[t][8 * i : 8 * i + 8], t) for t in texts)[1] for i in range(4)}))


def test_sample_values_are_bounded_and_the_same_for_any_partitioning(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('v', id % 900)) AS t", "cast(NULL AS int) AS none")
    seen = set()
    for parts in (1, 7):
        rows = profile.schema_profile(df.repartition(parts, F.rand(parts)), ["t"]).collect()
        values = rows[0]["sample"].split(", ")
        assert 1 < len(values) <= profile.SAMPLES and rows[1]["sample"] == "" and rows[1]["n_filled"] == 0
        seen.add(rows[0]["sample"])
    assert seen == {sample_of({r["t"] for r in df.collect()})}


def test_preview_is_a_top_k(spark):
    df = spark.range(100).repartition(4)
    out = profile.preview(df, "id", 3)
    assert [r[0] for r in out.collect()] == [0, 1, 2]
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("low,high", [(None, None), (0.0, 50.0)])
def test_histogram_counts_every_value_once(spark, low, high):
    values = [float(v) for v in np.random.default_rng(1).normal(30, 9, 500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    out = histogram.histogram(df, F.col("v"), 20, low, high).collect()
    inside = [v for v in values if low is None or low <= v <= high]
    span = (min(values), max(values)) if low is None else (low, high)
    assert [r["bin"] for r in out] == list(range(20))
    assert [r["n"] for r in out] == list(np.histogram(inside, bins=20, range=span)[0])


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert [r["n"] for r in histogram.histogram(df, F.col("v"), 3).collect()] == [2, 0, 0]
    void = df.where("false")
    assert [r["n"] for r in histogram.histogram(void, F.col("v"), 3).collect()] == [0, 0, 0]


def test_grid_counts(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0), (0.1, 9.9), (10.0, 10.0), (11.0, 5.0), (None, 1.0)], "x double, y double"
    )
    out = histogram.grid_counts(df, F.col("x"), F.col("y"), 0.0, 10.0, 10).collect()
    assert {tuple(r) for r in out} == {(0, 0, 1), (0, 9, 1), (9, 9, 1)}


def test_box_statistics_per_level(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None, i % 2, float(v)) for i, v in enumerate(rng.standard_t(2, 900))]
    df = spark.createDataFrame(rows, "f string, g int, y double")
    df = df.withColumn("key", F.monotonically_increasing_id())
    found = boxplot.boxes(df, "y", ["f", "g"], {"g": ["1", "0"]}, "key")
    out = boxplot.box_stats(found).collect()
    assert {(r["factor"], r["level"], r["place"]) for r in out} == {
        ("f", "hot", None), ("f", None, None), ("g", "0", 2), ("g", "1", 1),
    }
    outside = 0
    for r in out:
        at = 0 if r["factor"] == "f" else 1
        values = np.array([v[2] for v in rows if (v[at] if at == 0 else str(v[at])) == r["level"]])
        q1, median, q3 = np.quantile(values, [0.25, 0.5, 0.75])
        ok = (values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))
        assert (r["n"], r["n_outliers"]) == (len(values), (~ok).sum())
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, median, q3))
        assert (r["whisker_low"], r["whisker_high"]) == (values[ok].min(), values[ok].max())
        outside += r["n_outliers"]
    points = boxplot.box_outliers(found)
    assert points.columns == ["key", "y", "factor", "level"] and points.count() == outside


def test_levels_off_the_axis_are_left_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "f string, y double")
    out = boxplot.box_stats(boxplot.boxes(df, "y", ["f"], {"f": ["b"]})).collect()
    assert [(r["level"], r["place"]) for r in out] == [("b", 1)]


def test_not_a_number_is_refused(spark):
    from hedonica.operators.histogram import histogram

    for odd in (float("nan"), float("inf")):
        df = spark.createDataFrame([(1.0,), (odd,), (2.0,)], "v double")
        with pytest.raises(Exception, match="not a number|not finite"):
            histogram(df, F.col("v"), 4).collect()


def test_numbers_are_coded_by_value(spark):
    df = spark.createDataFrame([(2,), (9,), (10,), (100,), (-3,), (None,)], "n int")
    got = {r["level"]: r["code"] for r in profile.level_codes(df, ["n"]).collect()}
    assert got == {"-3": 1, "2": 2, "9": 3, "10": 4, "100": 5}


def test_levels_with_one_lead_are_coded_over_many_tasks(spark):
    df = spark.range(100_000).selectExpr("concat('Customer#', lpad(id, 9, '0')) AS c", "id % 3 AS n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        codes = profile.level_codes(df, ["c", "n"])
        wrong = codes.where("factor = 'c' AND code <> cast(substring(level, 10) AS int) + 1")
        assert wrong.count() == 0 and codes.count() == 100_003
        parts = profile.written(spark.range(1), "t")  # the helper that holds the ranges
        assert parts.count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_floating_levels_are_coded_by_value(spark):
    values = [1e300, -1e300, 1e-12, 2e-12, 0.0, 5.0, 10.0, math.inf, -math.inf, math.nan, None, 3.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["level"]: r["code"] for r in profile.level_codes(df, ["x"]).collect()}
    wanted = ["-Infinity", "-1.0E300", "0.0", "1.0E-12", "2.0E-12", "3.5", "5.0", "10.0", "1.0E300", "Infinity", "NaN"]
    assert got == {v: i for i, v in enumerate(wanted, start=1)}
    close = spark.createDataFrame([(2**60 + 1,), (2**60,), (2**60 + 2,)], "x bigint")
    got = {int(r["level"]) - 2**60: r["code"] for r in profile.level_codes(close, ["x"]).collect()}
    assert got == {0: 1, 1: 2, 2: 3}


def test_codes_of_earlier_loads_never_move(spark):
    loads = [[("m", 9), ("b", 10), (None, 2)], [("a", 10), ("z", 1), ("b", 9)], [("m", 9)], [("c", 30)]]
    known = spark.createDataFrame([], "factor string, level string, code bigint")
    for rows in loads:
        df = spark.createDataFrame(rows, "t string, n int")
        known = profile.written(known.union(profile.new_codes(df, ["t", "n"], known)), "codes")
    got = {(r["factor"], r["level"]): r["code"] for r in known.collect()}
    assert got == {
        ("t", "b"): 1, ("t", "m"): 2, ("t", "a"): 3, ("t", "z"): 4, ("t", "c"): 5,
        ("n", "2"): 1, ("n", "9"): 2, ("n", "10"): 3, ("n", "1"): 4, ("n", "30"): 5,
    }
    first = spark.createDataFrame(loads[0], "t string, n int")
    plain = {tuple(r) for r in profile.level_codes(first, ["t", "n"]).collect()}
    empty = spark.createDataFrame([], "factor string, level string, code bigint")
    assert {tuple(r) for r in profile.new_codes(first, ["t", "n"], empty).collect()} == plain

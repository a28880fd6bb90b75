import math

import numpy as np
import pytest
from hedonica.functions import metrics, student
from hedonica.operators import diagnose
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(5, 0.4, 400)
    y = 0.4 + 0.93 * x + rng.normal(0, 0.3, 400)
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")


def test_line_leaves_out_missing_pairs(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (2.0, 2.0), (3.0, 2.5), (4.0, None), (5.0, 4.0)], "x double, y double"
    )
    row = diagnose.line(df, "y", "x").first()
    assert row["n"] == 4
    assert row["slope"] == pytest.approx(0.72857142857)
    assert row["intercept"] == pytest.approx(0.37142857143)


def test_line_summary_equals_the_ml_summary(spark, points):
    fitted = diagnose.line_summary(points, "y", "x").first()
    tails = diagnose.line_tails(diagnose.line(points, "y", "x")).first()
    table = VectorAssembler(inputCols=["x"], outputCol="f").transform(points)
    ml = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(table).summary
    assert fitted["slope"] == pytest.approx(ml._call_java("tValues")[0] * ml.coefficientStandardErrors[0])
    assert [fitted["se_slope"], fitted["se_intercept"]] == pytest.approx(ml.coefficientStandardErrors)
    assert [fitted["t_slope"], fitted["t_intercept"]] == pytest.approx(ml.tValues)
    assert [tails["p_slope"], tails["p_intercept"]] == pytest.approx(ml.pValues, abs=1e-9)
    assert (fitted["r2"], fitted["adj_r2"]) == pytest.approx((ml.r2, ml.r2adj))
    residuals = [r[0] for r in ml.residuals.collect()]
    five = [fitted[c] for c in ("res_min", "res_q1", "res_median", "res_q3", "res_max")]
    assert five == pytest.approx(list(np.quantile(residuals, [0, 0.25, 0.5, 0.75, 1])), abs=1e-9)


def test_slope_against_one(spark, points):
    """The slope of y - x on x is tested against zero."""
    row = diagnose.line(points, "y", "x").first()
    tails = diagnose.tails(row)
    table = VectorAssembler(inputCols=["x"], outputCol="f").transform(
        points.withColumn("d", F.col("y") - F.col("x"))
    )
    ml = LinearRegression(featuresCol="f", labelCol="d", solver="normal").fit(table).summary
    assert row["f_slope_is_one"] == pytest.approx(ml.tValues[0] ** 2, rel=1e-8)
    assert row["f_slope_is_one"] == pytest.approx(((row["slope"] - 1) / row["se_slope"]) ** 2)
    assert tails["p_slope_is_one"] == pytest.approx(ml.pValues[0], abs=1e-9)
    assert (tails["slope_low"] + tails["slope_high"]) / 2 == pytest.approx(row["slope"])


def test_line_of_a_constant_is_undefined_not_an_error(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = diagnose.line(df, "y", "x").first()
    assert row["slope"] is None and row["se_slope"] is None


# Published table values of Student's t.
@pytest.mark.parametrize("p,df,t", [(0.975, 1, 12.7062), (0.975, 10, 2.2281), (0.95, 30, 1.6973),
                                    (0.975, 120, 1.9799), (0.995, 5, 4.0321)])
def test_t_quantiles(p, df, t):
    assert student.t_quantile(p, df) == pytest.approx(t, abs=5e-5)
    assert student.t_two_sided(t, df) == pytest.approx(2 * (1 - p), abs=1e-5)


def test_tails_of_large_samples_are_normal():
    assert student.t_quantile(0.975, 1e11) == pytest.approx(1.959963984540, abs=1e-9)
    # Both methods agree where one takes over from the other.
    below, above = (student.t_two_sided(1.7, df) for df in (999_999, 1_000_000))
    assert below == pytest.approx(above, abs=1e-9)
    assert student.t_quantile(0.975, 999_999) == pytest.approx(1.959966357, abs=1e-8)
    assert student.t_two_sided(0.0, 7) == pytest.approx(1.0)
    assert student.f_upper(4.0, 50) == pytest.approx(student.t_two_sided(2.0, 50))


def test_null_policy_of_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, None), (1.0, 1.0)], "t double, p double")
    t, p = F.col("t"), F.col("p")
    row = df.agg(
        metrics.rmse(t, p), metrics.rmse(t, p, "skip"), metrics.share(p <= 1),
        metrics.share(p <= 1, "skip"), metrics.null_count(p),
    ).first()
    assert tuple(row) == (None, pytest.approx(math.sqrt(0.5)), None, 0.5, 1)
    with pytest.raises(ValueError):
        metrics.rmse(t, p, "other")


def test_pairs_errors_and_coverage(spark):
    scored = spark.createDataFrame([(4.0, 4.0), (5.0, 4.0), (4.0, 5.0), (4.0, None)], "y double, p double")
    pairs = diagnose.pairs(scored, "y", "p")
    assert [r["diff"] for r in pairs.collect()] == [0.0, 90000.0, 90000.0, None]
    row = diagnose.price_error(pairs, "price").first()
    sd = np.std([1e4, 1e5, 1e4, 1e4], ddof=1)
    assert tuple(row) == pytest.approx((32500.0, sd, 4, sd / 2, sd))
    full = pairs.where("diff is not null")
    out = diagnose.coverage(full, "diff", 10.0, 1e5).first()
    assert tuple(out) == pytest.approx((1 / 3, 1.0, 0))
    assert tuple(diagnose.coverage(pairs, "diff", 10.0, 1e5).first()) == (None, None, 1)


def test_axis_limits_drop_points(spark):
    df = spark.createDataFrame([(4.0, 4.0), (3.9, 5.0), (9.4, 5.0)], "y double, p double")
    assert df.where(diagnose.within_limits(["y", "p"], 1e4, 2.2e9)).count() == 1


def test_judgement_is_one_scan_with_the_parts_equal(spark, points):
    df = points.withColumn("price", F.pow(F.lit(10.0), "y"))
    row = diagnose.judgement(df, "price", "y", "x", 1e4, 1e5).first().asDict()
    errors = diagnose.price_error(df, "price").first().asDict()
    line = diagnose.line(df, "y", "x").first().asDict()
    plotted = diagnose.line(df.where("x between 4 and 5 and y between 4 and 5"), "y", "x").first()
    for name, value in {**errors, **line}.items():
        assert row[name] == pytest.approx(value)
    assert 0 < plotted["n"] < 400
    for name in ("n", "slope", "intercept", "r2"):
        assert row["plotted_" + name] == pytest.approx(plotted[name])


@pytest.mark.parametrize("rows", [
    [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, 8.0)],  # exact
    [(1.0, 2.0), (1.0, 4.0), (1.0, 6.0)],  # constant x
    [(1.0, 2.0), (2.0, 5.0)],  # two points
    [(1.0, 2.0)],
])
def test_tails_of_degenerate_lines(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double")
    found = diagnose.line_tails(diagnose.line(df, "y", "x")).first().asDict()
    if len(rows) < 4:
        assert set(found.values()) == {None}
    else:
        assert found["p_slope"] in (None, 0.0)


def test_judgement_counts_unscored_rows(spark):
    df = spark.createDataFrame(
        [(10.0, 1.0, 1.0), (10.0, 2.0, 2.5), (20.0, 3.0, None)], "price double, y double, x double"
    )
    assert diagnose.judgement(df, "price", "y", "x", 1.0, 1e9).first()["n_unscored"] == 1

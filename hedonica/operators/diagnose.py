"""How well predictions agree with actual values: spread, coverage, regression line."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hedonica.functions.metrics import null_count, share
from hedonica.functions.scalars import from_log10
from hedonica.functions.student import f_upper, t_quantile, t_two_sided
from hedonica.operators.quantiles import exact_quantiles
from hedonica.session import literal_rows, settled


def pairs(scored: DataFrame, y: str, pred: str, keep: Sequence[str] = ()) -> DataFrame:
    """Actual and predicted log value, both back-transformed, and their absolute gap."""
    actual, expected = from_log10(F.col(y)), from_log10(F.col(pred))
    return scored.select(
        *keep,
        F.col(y),
        F.col(pred),
        F.abs(expected - actual).alias("diff"),
        actual.alias("price"),
        expected.alias("pred"),
    )


def error_sums(value: Column) -> list[Column]:
    return [
        F.avg(value).alias("mean_price"),
        F.stddev_samp(value).alias("sd_price"),
        F.count(F.lit(1)).alias("n_price"),
    ]


def error_statistics(sums: DataFrame) -> DataFrame:
    """Add the standard error of the mean, and twice that."""
    se = F.col("sd_price") / F.sqrt("n_price")
    return sums.withColumn("se1", se).withColumn("se2", se * 2)


def price_error(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, sample deviation, rows, standard error and twice that."""
    return error_statistics(df.agg(*error_sums(F.col(value))))


def coverage(df: DataFrame, diff: str, se1: float, se2: float, nulls: str = "propagate"):
    """One row: shares of gaps within one and two standard errors, and unscored rows."""
    gap = F.col(diff)
    return df.agg(
        share(gap <= F.lit(se1), nulls).alias("within_1se"),
        share(gap <= F.lit(se2), nulls).alias("within_2se"),
        F.count_if(gap.isNull()).alias("n_null_pred"),
    )


def line_sums(y: Column, x: Column, prefix: str = "") -> list[Column]:
    sums = {
        "n": F.regr_count(y, x),
        "slope": F.regr_slope(y, x),
        "intercept": F.regr_intercept(y, x),
        "r2": F.regr_r2(y, x),
        "sxx": F.regr_sxx(y, x),
        "syy": F.regr_syy(y, x),
        "sxy": F.regr_sxy(y, x),
        "mean_x": F.regr_avgx(y, x),
        "gap_syy": F.regr_syy(y - x, x),
        "gap_sxy": F.regr_sxy(y - x, x),
    }
    return [value.alias(prefix + name) for name, value in sums.items()]


def line_statistics(sums: DataFrame) -> DataFrame:
    """Add errors, t and F statistics to the sums of a line.

    The slope's distance from one is tested through the correlation of y - x with x.
    """
    n, sxx = F.col("n"), F.col("sxx")
    shared = F.col("gap_sxy") * F.col("gap_sxy")
    ratio = F.try_divide
    mse = ratio(F.col("syy") - ratio(F.col("sxy") * F.col("sxy"), sxx), n - 2)
    at_zero = ratio(F.lit(1.0), n) + ratio(F.col("mean_x") * F.col("mean_x"), sxx)
    return (
        sums.withColumn("mse", mse)
        .withColumn("rse", F.sqrt("mse"))
        .withColumn("se_slope", F.sqrt(ratio(F.col("mse"), sxx)))
        .withColumn("se_intercept", F.sqrt(F.col("mse") * at_zero))
        .withColumn("t_slope", ratio(F.col("slope"), F.col("se_slope")))
        .withColumn("t_intercept", ratio(F.col("intercept"), F.col("se_intercept")))
        .withColumn("adj_r2", F.lit(1.0) - ratio((F.lit(1.0) - F.col("r2")) * (n - 1), n - 2))
        .withColumn("f_line", F.col("t_slope") * F.col("t_slope"))
        .withColumn("f_slope_is_one", ratio((n - 2) * shared, F.col("gap_syy") * sxx - shared))
    )


def line(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: least-squares line of y on x; pairs with a NULL are left out."""
    return line_statistics(df.agg(*line_sums(F.col(y), F.col(x))))


PLOTTED = "plotted_"


def judgement(df: DataFrame, value: str, y: str, x: str, low: float, high: float) -> DataFrame:
    """One row from one scan: price error, line, and the line of the points inside limits.

    ``n_unscored`` counts the rows without a prediction ``x``, which no line can use.
    """
    inside = within_limits([y, x], low, high)
    sums = df.agg(
        *error_sums(F.col(value)),
        null_count(F.col(x)).alias("n_unscored"),
        *line_sums(F.col(y), F.col(x)),
        *line_sums(F.when(inside, F.col(y)), F.when(inside, F.col(x)), PLOTTED),
    )
    return settled(line_statistics(error_statistics(sums)), "judgement")[0]


def residual_quantiles(df: DataFrame, y: str, x: str, slope: float, intercept: float) -> list:
    """Least, quartiles and greatest residual of a line."""
    residual = F.col(y) - (F.lit(intercept) + F.lit(slope) * F.col(x))
    row = exact_quantiles(df.select(residual.alias("r")), "r", [0.0, 0.25, 0.5, 0.75, 1.0]).first()
    return list(row["q"]) if row is not None else [None] * 5


FIVE_NUMBERS = ["res_min", "res_q1", "res_median", "res_q3", "res_max"]


def line_summary(df: DataFrame, y: str, x: str, fitted: DataFrame | None = None) -> DataFrame:
    """The line's one row plus the five-number summary of its residuals."""
    fitted = line(df, y, x) if fitted is None else fitted
    row = fitted.first()
    five = residual_quantiles(df, y, x, row["slope"], row["intercept"])
    schema = StructType(fitted.schema.fields + [StructField(c, DoubleType()) for c in FIVE_NUMBERS])
    return literal_rows(df.sparkSession, [(*row, *five)], schema)


def tails(fitted: Row, level: float = 0.95) -> dict[str, float]:
    """p-values and confidence limits of a fitted line, from its one row of statistics.

    What an exact fit, a constant x or fewer than three points leave open is None.
    """
    df = fitted["n"] - 2

    def tail(f, statistic: str) -> float | None:
        value = fitted[statistic]
        return None if value is None or df < 1 else f(value, df)

    def limit(name: str, sign: int) -> float | None:
        value, error = fitted[name], fitted[f"se_{name}"]
        if value is None or error is None or df < 1:
            return None
        return value + sign * t_quantile(1.0 - (1.0 - level) / 2.0, df) * error

    return {
        "p_slope": tail(t_two_sided, "t_slope"),
        "p_intercept": tail(t_two_sided, "t_intercept"),
        "p_line": tail(f_upper, "f_line"),
        "p_slope_is_one": tail(f_upper, "f_slope_is_one"),
        "slope_low": limit("slope", -1),
        "slope_high": limit("slope", 1),
        "intercept_low": limit("intercept", -1),
        "intercept_high": limit("intercept", 1),
    }


def line_tails(fitted: DataFrame, level: float = 0.95) -> DataFrame:
    """p-values and confidence limits as a row, from the row of ``line``."""
    found = tails(fitted.first(), level)
    schema = ", ".join(f"{c} double" for c in found)
    return literal_rows(fitted.sparkSession, [tuple(found.values())], schema)


def within_limits(columns: Sequence[str], low: float, high: float) -> Column:
    """All values lie within axis limits, given in plain units of log10 columns."""
    ends = math.log10(low), math.log10(high)
    return reduce(lambda a, b: a & b, [F.col(c).between(*ends) for c in columns])

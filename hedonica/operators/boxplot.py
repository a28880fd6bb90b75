"""Box-plot statistics of a value per level of many factors, all factors in one go."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedonica.operators.profile import long_form
from hedonica.operators.quantiles import exact_quantiles
from hedonica.session import lookup, settled

# Bins of a pass for each of many groups: with fewer, a task shuffles fewer counts.
BINS = 128


def shown(axis: Mapping[str, Sequence[str]]) -> Column:
    """Factors with an axis list show the listed levels only."""
    out = ~F.col("factor").isin(*axis) if axis else F.lit(True)
    for factor, listed in axis.items():
        out = out | ((F.col("factor") == factor) & F.col("level").isin(*listed))
    return out


def axis_place(axis: Mapping[str, Sequence[str]]) -> Column:
    """Place of the level on its axis, from 1; NULL for factors without a list."""
    out = F.lit(None).cast("int")
    for factor, listed in axis.items():
        place = F.array_position(F.array(*[F.lit(v) for v in listed]), F.col("level"))
        out = F.when(F.col("factor") == factor, place.cast("int")).otherwise(out)
    return out


@dataclass(frozen=True)
class Boxes:
    """The points per factor and level, and each level's quartiles and fences."""

    y: str
    axis: Mapping[str, Sequence[str]]
    points: DataFrame
    table: DataFrame
    small: bool

    def joined(self, df: DataFrame, *columns: str) -> DataFrame:
        named = self.table.select(
            F.col("factor").alias("_factor"), F.col("level").alias("_level"), *columns
        )
        return lookup(df, named, {"factor": "_factor", "level": "_level"}, self.small, "inner")

    def inside(self) -> Column:
        return F.col(self.y).between(F.col("fence_low"), F.col("fence_high"))


def boxes(
    df: DataFrame,
    y: str,
    factors: Sequence[str],
    axis: Mapping[str, Sequence[str]] = {},
    key: str | None = None,
    coef: float = 1.5,
) -> Boxes:
    """Quartiles per level of every factor, and fences ``coef`` quartile ranges away."""
    points = long_form(df, factors, [key, y] if key else [y]).where(shown(axis))
    reach = F.lit(coef) * (F.col("q3") - F.col("q1"))
    table, small = settled(
        exact_quantiles(points, y, [0.25, 0.5, 0.75], by=["factor", "level"], bins=BINS)
        .select("factor", "level", "n", F.col("q")[0].alias("q1"),
                F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
        .withColumn("fence_low", F.col("q1") - reach)
        .withColumn("fence_high", F.col("q3") + reach),
        "boxes",
    )
    return Boxes(y, axis, points, table, small)


def box_stats(found: Boxes) -> DataFrame:
    """One row per (factor, level): n, quartiles, whiskers, number of outliers.

    Whiskers reach the outermost values within the fences.
    """
    value, inside = F.col(found.y), found.inside()
    ends = (
        found.joined(found.points, "fence_low", "fence_high")
        .groupBy("factor", "level")
        .agg(
            F.min(F.when(inside, value)).alias("inner_low"),
            F.max(F.when(inside, value)).alias("inner_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
    return found.joined(ends, "n", "q1", "median", "q3").select(
        "factor",
        "level",
        axis_place(found.axis).alias("place"),
        "n",
        F.least("q1", "inner_low").alias("whisker_low"),
        "q1",
        "median",
        "q3",
        F.greatest("q3", "inner_high").alias("whisker_high"),
        "n_outliers",
    )


def box_outliers(found: Boxes) -> DataFrame:
    """The points drawn beyond the whiskers."""
    return (
        found.joined(found.points, "fence_low", "fence_high")
        .where(~found.inside())
        .drop("fence_low", "fence_high")
    )

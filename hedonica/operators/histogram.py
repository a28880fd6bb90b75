"""Equal-width bin counts in one and two dimensions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, low: float, width: float, bins: int) -> Column:
    """Bin number from 0; the upper end belongs to the last bin."""
    place = F.floor((value - F.lit(low)) / F.lit(width))
    return F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(
    df: DataFrame,
    value: Column,
    bins: int = 100,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """(bin, lower, n) for every bin, empty ones included.

    Bins span the data, or the given limits; values outside the limits are left out. NaN is
    refused.
    """
    plain = value.cast("double")
    refused = F.raise_error(F.lit("a value is not a number")).cast("double")
    data = df.select(F.when(F.isnan(plain), refused).otherwise(plain).alias("v"))
    data = data.where(F.col("v").isNotNull())
    if low is None or high is None:
        span = data.agg(F.min("v").alias("low"), F.max("v").alias("high")).first()
        low = span["low"] if low is None else low
        high = span["high"] if high is None else high
    if low is None:
        low = high = 0.0
    if math.isinf(low) or math.isinf(high):
        raise ValueError("values are not finite; give limits")
    width = (high - low) / bins or 1.0
    counts = (
        data.where(F.col("v").between(low, high))
        .groupBy(bin_of(F.col("v"), low, width, bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counts, "bin", "left")
        .select(
            "bin",
            (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )


def grid_counts(
    df: DataFrame, x: Column, y: Column, low: float, high: float, bins: int = 100
) -> DataFrame:
    """(x_bin, y_bin, n) of the points inside the limits; empty cells are not listed."""
    width = (high - low) / bins
    return (
        df.select(x.alias("x"), y.alias("y"))
        .where(F.col("x").between(low, high) & F.col("y").between(low, high))
        .groupBy(
            bin_of(F.col("x"), low, width, bins).alias("x_bin"),
            bin_of(F.col("y"), low, width, bins).alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )

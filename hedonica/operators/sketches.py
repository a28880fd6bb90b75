"""Profiles that add up: quantiles, numbers of levels and frequent levels from bounded states.

The exact forms (``quantiles``, ``profile.level_counts``) read all rows again whenever a day is
added. A state here is small, is taken in one scan of the new rows, is saved for each slice, and
states are merged in any order. All three are Spark's own sketches, updated map-side, so a level
that holds a third of the rows is a state of bounded size from every task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedonica.operators.effects import sketched
from hedonica.operators.profile import long_form

# KLL: the rank of a quantile is off by less than RANK_ERROR(k) of the rows in 99 of 100 cases.
KLL_K = 400
QUANTILE_STATE = "factor string, level string, n bigint, low double, high double, sketch binary"
# HLL: 2**LG_K registers; a number of levels is off by LEVEL_ERROR(lg_k) of it (one deviation).
LG_K = 14
LEVEL_STATE = "factor string, n_filled bigint, sketch binary"


def rank_error(k: int = KLL_K) -> float:
    return 2.296 / k**0.9723


def level_error(lg_k: int = LG_K) -> float:
    return 1.04 / math.sqrt(2**lg_k)


# --- quantiles by level -----------------------------------------------------------------


def quantile_state(df: DataFrame, value: str, factors: Sequence[str], k: int = KLL_K) -> DataFrame:
    """See ``QUANTILE_STATE``: a sketch of the value for each level of each factor; one scan.

    NULL values are left out; a NULL level is a level. Smallest and largest value are exact.
    """
    rows = long_form(df.where(F.col(value).isNotNull()), factors, [value])
    v = F.col(value).cast("double")
    return rows.groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"),
    )


def merged_quantiles(state: DataFrame, k: int = KLL_K) -> DataFrame:
    """States of several slices as one: a state again."""
    return state.groupBy("factor", "level").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )


def quantiles_of(state: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``factor, level, n, q``: values of the data whose rank is near that of each quantile."""
    ranks = F.array(*[F.lit(float(p)) for p in probs])
    return state.select("factor", "level", "n", F.kll_sketch_get_quantile_double("sketch", ranks).alias("q"))


def rank_gaps(df: DataFrame, value: str, found: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``factor, level, n, gaps``: how far, in shares of n, the exact rank of each value in ``q``
    is from the wanted one. Ranks of equal values are a range; within it the gap is 0."""
    factors = [r["factor"] for r in found.select("factor").distinct().collect()]
    rows = long_form(df.where(F.col(value).isNotNull()), factors, [value])
    named = found.select(F.col("factor").alias("_factor"), F.col("level").alias("_level"), "q")
    on = (rows["factor"] == named["_factor"]) & rows["level"].eqNullSafe(named["_level"])
    counts = [c for i in range(len(probs)) for c in (
        F.count_if(F.col(value) < F.col("q")[i]).alias(f"less{i}"),
        F.count_if(F.col(value) <= F.col("q")[i]).alias(f"upto{i}"),
    )]
    ranked = rows.join(named, on).groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"), *counts)
    gaps = [
        F.greatest(F.col(f"less{i}") - F.lit(p) * F.col("n"), F.lit(p) * F.col("n") - F.col(f"upto{i}"), F.lit(0.0)) / F.col("n")
        for i, p in enumerate(probs)
    ]
    return ranked.select("factor", "level", "n", F.array(*gaps).alias("gaps"))


# --- numbers of levels ------------------------------------------------------------------


def level_state(df: DataFrame, factors: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """See ``LEVEL_STATE``: a sketch of the levels of each factor; one scan, NULL not counted."""
    one = df.agg(
        *[F.count(f).alias(f"n{i}") for i, f in enumerate(factors)],
        *[F.hll_sketch_agg(sketched(df, f), lg_k).alias(f"s{i}") for i, f in enumerate(factors)],
    )
    rows = F.array(*[
        F.struct(F.lit(f).alias("factor"), F.col(f"n{i}").alias("n_filled"), F.col(f"s{i}").alias("sketch"))
        for i, f in enumerate(factors)
    ])
    return one.select(F.inline(rows))


def merged_levels(state: DataFrame) -> DataFrame:
    return state.groupBy("factor").agg(
        F.sum("n_filled").alias("n_filled"), F.hll_union_agg("sketch").alias("sketch")
    )


def levels_of(state: DataFrame) -> DataFrame:
    """``factor, n_levels, n_filled``; ``n_levels`` within the sketch's error."""
    return state.select("factor", F.hll_sketch_estimate("sketch").alias("n_levels"), "n_filled")


# --- frequent levels --------------------------------------------------------------------


def heavy_levels(df: DataFrame, columns: Sequence[str], share: float) -> DataFrame:
    """``factor, level, n``: every level that more than ``share`` of all rows hold, counted.

    A first scan keeps, in every task, a summary of at most ``1 / share`` levels a column, which
    holds each level above the share; a second counts only those. No other level is shuffled,
    however many there are. NULL counts as a level.
    """
    if not 0 < share < 1:
        raise ValueError("share must be between 0 and 1")
    text = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    names = text.columns
    # a NULL has no place in a summary, so every level gets a mark before it
    marked = text.select(*[F.coalesce(F.concat(F.lit("="), n), F.lit("")).alias(n) for n in names])
    row = marked.freqItems(names, share).first()
    wanted = [set(row[f"{n}_freqItems"] or []) for n in names]
    listed = [
        F.when(F.col(n).isin(*levels), F.struct(F.lit(c).alias("factor"), F.col(n).alias("level")))
        for n, c, levels in zip(names, columns, wanted) if levels
    ]
    if not listed:
        return df.sparkSession.createDataFrame([], "factor string, level string, n bigint")
    found = marked.select(F.inline(F.filter(F.array(*listed), lambda x: x.isNotNull())))
    least = F.lit(float(share)) * F.lit(df.count())
    counted = found.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    level = F.when(F.col("level") != "", F.substring("level", 2, 2147483647))
    return counted.select("factor", level.alias("level"), "n")

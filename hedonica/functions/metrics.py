"""Aggregate expressions judging a prediction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hedonica.functions.scalars import indicator


def with_nulls(value: Column, over: Column, nulls: str) -> Column:
    """An aggregate that is NULL if any input is ('propagate'), or ignores them ('skip')."""
    if nulls == "skip":
        return value
    if nulls != "propagate":
        raise ValueError("nulls must be 'propagate' or 'skip'")
    return F.when(F.count(over) == F.count(F.lit(1)), value)


def rmse(actual: Column, predicted: Column, nulls: str = "propagate") -> Column:
    gap = actual - predicted
    return with_nulls(F.sqrt(F.avg(gap * gap)), gap, nulls)


def share(condition: Column, nulls: str = "propagate") -> Column:
    """Share of rows where the condition holds."""
    flag = indicator(condition)
    return with_nulls(F.avg(flag), flag, nulls)


def null_count(value: Column) -> Column:
    return F.count_if(value.isNull())

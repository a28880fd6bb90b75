"""Column expressions for cleaning: amounts, dates, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing_if_contains(text: Column, sentinel: str) -> Column:
    """The text, or NULL where it contains the sentinel."""
    return F.when(~text.contains(sentinel), text)


def number(text: Column) -> Column:
    """Text to double; unreadable text gives NULL, also in ANSI mode."""
    return text.try_cast("double")


def day_of(value: Column) -> Column:
    """Date of a timestamp or of a text starting with yyyy-MM-dd."""
    return value.try_cast("date")


def decade(year: Column) -> Column:
    return year - F.pmod(year, F.lit(10))


def weekday(day: Column) -> Column:
    """Full English weekday name."""
    return F.date_format(day, "EEEE")


def first_letter(text: Column) -> Column:
    return F.substring(text, 1, 1)


def bucketize(value: Column, buckets: Sequence[tuple]) -> Column:
    """Label of the first bucket holding the value; NULL where none does.

    A bucket is (label, lowest, highest, lowest is excluded); ``None`` means no bound.
    """
    out = None
    for label, low, high, excluded in buckets:
        if low == high:
            inside = value == F.lit(low)
        else:
            inside = value > F.lit(low) if excluded else value >= F.lit(low)
            if high is not None:
                inside = inside & (value <= F.lit(high))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def dominant(first: Column, second: Column, first_label: str, second_label: str) -> Column:
    """Label of the larger count, ties to the first; NULL if either is missing."""
    return F.when(first >= second, first_label).when(first < second, second_label)


def from_log10(value: Column) -> Column:
    return F.pow(F.lit(10.0), value)


def indicator(condition: Column) -> Column:
    """1.0 where true, 0.0 where false, NULL where unknown."""
    return F.when(condition, 1.0).when(~condition, 0.0)

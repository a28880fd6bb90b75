"""Counts, ranges, levels and previews of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from hedonica.session import literal_rows, written


def overview(df: DataFrame, day: Column, amount: Column) -> DataFrame:
    """One row: number of rows, first and last day, smallest and largest amount."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.min(amount).alias("min_amount"),
        F.max(amount).alias("max_amount"),
        F.count(amount).alias("n_amounts"),
    )


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per level; missing levels are not listed."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(column)
    )


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, factor, level) for every column, levels as text; one scan."""
    text = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot(list(keep), list(columns), "factor", "level")


def levels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(factor, level, n): rows per level of each column, NULL included."""
    return long_form(df, columns).groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"))


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of levels per column, NULL not counted.

    Rows are first reduced to distinct levels, so a level held by most rows costs nothing.
    """
    return levels(df, columns).groupBy("factor").agg(
        F.count("level").alias("n_levels"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("n"))), F.lit(0)).alias("n_filled"),
    )


def approx_level_counts(df: DataFrame, columns: Sequence[str], rsd: float = 0.05) -> DataFrame:
    """As ``level_counts``, estimated with one sketch per column."""
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns]).unpivot(
        [], list(columns), "factor", "n_levels"
    )


SAMPLES = 4


def sample_values(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Aggregates: for each column, up to ``SAMPLES`` of its values as text.

    A value's MD5 is cut into as many parts, and the value that is least in each is taken: a
    bounded state that adds up map-side and doesn't depend on how rows are dealt to tasks.
    Floating columns are shown with six decimals; NULL is no value.
    """
    out = []
    for f in (df.schema[c] for c in columns):
        floating = f.dataType.simpleString() in ("double", "float")
        text = F.format_string("%.6f", F.col(f.name)) if floating else F.col(f.name).cast("string")
        text = F.when(F.col(f.name).isNotNull(), text)
        digest, size = F.md5(text), 32 // SAMPLES
        parts = [F.substring(digest, 1 + i * size, size) for i in range(SAMPLES)]
        picks = [F.min(F.when(text.isNotNull(), F.struct(p.alias("p"), text.alias("v"))))["v"] for p in parts]
        out.append(F.array_sort(F.array_distinct(F.array_compact(F.array(*picks)))).alias(f.name))
    return out


def schema_profile(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Name, type, filled rows and some values of each column; the number of levels of factors."""
    described = literal_rows(
        df.sparkSession,
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields, start=1)],
        "position int, column string, type string",
    )
    one = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[v.alias(f"v{i}") for i, v in enumerate(sample_values(df, df.columns))],
    )
    shown = one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("factor"), F.col(f"n{i}").alias("n_filled"), F.array_join(f"v{i}", ", ").alias("sample"))
        for i, c in enumerate(df.columns)
    ])))
    counted = level_counts(df, [c for c in df.columns if c in factors]).select("factor", "n_levels")
    return (
        described.join(shown, described["column"] == shown["factor"]).drop("factor")
        .join(counted, F.col("column") == counted["factor"], "left")
        .select("position", "column", "type", "n_filled", "n_levels", "sample")
        .orderBy("position")
    )


def preview(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The first rows in key order: a bounded top-k, no full sort."""
    return df.orderBy(key).limit(rows)


def value_order(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """What orders the levels (as text) of a factor: numbers by value, all else by bytes.

    By double first, which holds NaN (last), infinities and any size; then numbers that are
    equal as doubles by decimal, and what is left by text.
    """
    numeric = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, NumericType)]
    level = F.when(F.col("factor").isin(*numeric), F.col("level"))
    return [level.try_cast("double").alias("value"), level.try_cast("decimal(38,9)").alias("finer")]


def placed(found: DataFrame, order: Sequence[str], offsets: DataFrame | None = None) -> DataFrame:
    """(factor, level, code): rows of unlike levels numbered from 1 by factor, in the order given.

    Levels are sorted into ranges over all tasks; a level's code is its place in its range and
    the number of levels in the ranges before, so no list of levels is ranked in one task,
    whatever its levels have in common. ``offsets`` (factor, base) are added.
    """
    ranged = written(
        found.repartitionByRange("factor", *order).withColumn("part", F.spark_partition_id()), "levels"
    )
    earlier = Window.partitionBy("factor").orderBy("part")
    starts = (
        ranged.groupBy("factor", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.sum("n").over(
            earlier.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .drop("n")
    )
    if offsets is not None:
        starts = starts.join(offsets, "factor", "left").withColumn(
            "offset", F.col("offset") + F.coalesce("base", F.lit(0))
        ).drop("base")
    within = Window.partitionBy("factor", "part").orderBy(*order)
    return ranged.withColumn("place", F.row_number().over(within)).join(starts, ["factor", "part"]).select(
        "factor", "level", (F.col("offset") + F.col("place")).cast("bigint").alias("code")
    )


ORDER = ["value", "finer", "level"]


def level_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(factor, level, code): levels numbered from 1, numbers by value, text by bytes."""
    found = levels(df, columns).where(F.col("level").isNotNull())
    return placed(found.select("factor", *value_order(df, columns), "level"), ORDER)


def new_codes(df: DataFrame, columns: Sequence[str], known: DataFrame) -> DataFrame:
    """(factor, level, code) of the levels that the dictionary ``known`` lacks.

    They get the codes after the highest of their factor, in the order of ``level_codes``; codes
    given before never move. With an empty dictionary this is ``level_codes``. Save each load's
    codes as a slice, and read all slices as the next load's dictionary.
    """
    met = levels(df, columns).where(F.col("level").isNotNull())
    new = met.join(known, ["factor", "level"], "left_anti")
    highest = known.groupBy("factor").agg(F.max("code").alias("base"))
    return placed(new.select("factor", *value_order(df, columns), "level"), ORDER, highest)

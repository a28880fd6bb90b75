"""From raw sales to a tidy table of categories and log price.

Projections and filters only: one narrow stage that Spark fuses into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedonica import fixed_values as fixed
from hedonica.functions.scalars import (
    bucketize,
    day_of,
    decade,
    dominant,
    first_letter,
    missing_if_contains,
    number,
    weekday,
)
from hedonica.session import settled


def price_amount() -> Column:
    return number(missing_if_contains(F.col("price"), fixed.MISSING_AMOUNT))


def in_price_range(price: Column) -> Column:
    return (price >= fixed.PRICE_LOW) & (price < fixed.PRICE_HIGH)


def first_clean(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Categories of every sale whose price is in range; ``keep`` passes columns along."""
    res, com = F.col("res_units"), F.col("com_units")
    sold = day_of(F.col("sale_ts"))
    return raw.select(
        *keep,
        F.col("borough").cast("int").alias("borough"),
        F.col("zip").cast("int").alias("zip"),
        price_amount().alias("price"),
        bucketize(res, fixed.RES_UNIT_BUCKETS).alias("resunits"),
        bucketize(com, fixed.COM_UNIT_BUCKETS).alias("comunits"),
        dominant(res, com, "res", "com").alias("rescom"),
        bucketize(number(F.col("land_area")), fixed.AREA_BUCKETS).alias("landareacat"),
        bucketize(number(F.col("gross_area")), fixed.AREA_BUCKETS).alias("grossareacat"),
        decade(F.col("yr_built")).cast("int").alias("decade"),
        F.col("tax_class_sale").cast("int").alias("tax_class"),
        first_letter(F.col("bldg_class_sale")).alias("bldg_class"),
        weekday(sold).alias("day"),
        F.month(sold).alias("month"),
    ).where(in_price_range(F.col("price")))


def second_clean(clean: DataFrame, classes: Sequence[str] = fixed.KEPT_CLASSES) -> DataFrame:
    """Drop the zip, early or unknown decades, and classes not listed."""
    return clean.drop("zip").where(
        (F.col("decade") >= fixed.FIRST_DECADE) & F.col("bldg_class").isin(*classes)
    )


def with_log_price(df: DataFrame) -> DataFrame:
    """Prices are positive after the range filter, so the logarithm is never NULL."""
    return df.withColumn("logprice", F.log10("price"))


def tidy(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return with_log_price(second_clean(first_clean(raw, keep)))


def only_levels(df: DataFrame, column: str, levels: DataFrame) -> DataFrame:
    """Rows whose level is listed in the one-column table ``levels``; NULL never is."""
    listed, small = settled(levels.select(F.col(levels.columns[0]).alias("_level")), "levels")
    return df.join(
        F.broadcast(listed) if small else listed, df[column] == listed["_level"], "left_semi"
    )


def frequent_levels(df: DataFrame, column: str, min_rows: int) -> DataFrame:
    """Levels with more than ``min_rows`` rows; NULL is not a level here."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > min_rows)
    )


def keep_frequent(df: DataFrame, column: str, min_rows: int) -> DataFrame:
    """The rows of all levels with more than ``min_rows`` rows."""
    return only_levels(df, column, frequent_levels(df, column, min_rows))


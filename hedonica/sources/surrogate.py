"""A stand-in for the sales file, built from the order tables.

One sale per order line, shaped so that every category, sentinel and filter of the
cleaning rules occurs at every scale. Other joins are left to Spark: sizes decide what is
broadcast, and skewed keys are split at run time by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a line's discount and tax say about its price; all other lines have the price they name.
NO_PRICE, TOP_PRICE = 1, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> F.Column:
    """Order and line number repeat in the data; these five parts together do not."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return F.concat_ws("|", *[F.col(p).cast("string") for p in parts], cents.cast("string"))


def area(key: str, factor: int, zero_every: int, missing_digit: int, digit_of: str, zero_of: str):
    """Area text: a sentinel for one supplier digit, some zeros, else a spread of sizes."""
    return (
        F.when(F.col(digit_of) % 10 == missing_digit, " -  ")
        .when(F.col(zero_of) % zero_every == 0, "0")
        .otherwise(((F.col(key) * factor) % 6000).cast("string"))
    )


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # The one large table: shuffled, never the broadcast side, however small its files. It is
    # shuffled for each large key, so what is wide or takes few values is narrowed before.
    line = (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_linenumber",
            "l_quantity",
            F.when(F.col("l_discount") < 0.005, NO_PRICE)
            .when((F.col("l_tax") > 0.075) & (F.col("l_linenumber") == 7), TOP_PRICE)
            .alias("price_kind"),
        )
        .hint("merge")
    )

    # Orders meet their buyer first, so that lines are shuffled once per large key. Names of
    # places come last: up to there a sale carries the number of its nation.
    buyer = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_nationkey")
    place = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_regionkey"
    )
    sales = (
        line.join(buyer, line.l_orderkey == buyer.o_orderkey)
        .drop("o_orderkey")
        .join(part, line.l_partkey == part.p_partkey)
        .join(place, buyer.c_nationkey == place.n_nationkey)
    )

    quantity = F.col("l_quantity").cast("int")
    return sales.select(
        row_key().alias("row_key"),
        (F.col("r_regionkey") + 1).alias("borough"),
        F.col("n_name").alias("hood"),
        (F.col("n_nationkey") + 10000).alias("zip"),
        F.when(F.col("l_partkey") % 4 == 3, quantity % 4)
        .otherwise(quantity + F.col("l_linenumber") - 2)
        .alias("res_units"),
        (F.col("l_linenumber") - 1).alias("com_units"),
        area("l_partkey", 37, 20, 0, "l_suppkey", "l_partkey").alias("land_area"),
        area("l_orderkey", 53, 25, 1, "l_suppkey", "l_orderkey").alias("gross_area"),
        F.when(F.col("p_size") == 1, 0).otherwise(F.col("p_size") * 3 + 1870).alias("yr_built"),
        (F.col("l_suppkey") % 4 + 1).cast("int").alias("tax_class_sale"),
        F.concat(
            F.char((F.col("l_partkey") % 26 + 65).cast("int")),
            (F.col("p_size") % 10).cast("string"),
        ).alias("bldg_class_sale"),
        F.when(F.col("price_kind") == NO_PRICE, " -  ")
        .when(F.col("price_kind") == TOP_PRICE, "2210000000")
        .otherwise(F.floor("l_extendedprice").cast("bigint").cast("string"))
        .alias("price"),
        F.col("l_shipdate").alias("sale_ts"),
    )


def as_sales_file(raw: DataFrame) -> DataFrame:
    """The surrogate laid out as the 22 text columns of the sales file, in order."""
    text = {c: F.col(c).cast("string") for c in raw.columns}
    return raw.select(
        F.lit("0").alias("id"),
        text["borough"].alias("borough"),
        text["hood"].alias("hood"),
        F.lit("NA").alias("bldg_class_cat"),
        text["tax_class_sale"].alias("tax_class_present"),
        F.lit("0").alias("block"),
        F.lit("0").alias("lot"),
        F.lit(" ").alias("easement"),
        text["bldg_class_sale"].alias("bldg_class_present"),
        text["row_key"].alias("address"),
        F.lit(" ").alias("apt_num"),
        text["zip"].alias("zip"),
        text["res_units"].alias("res_units"),
        text["com_units"].alias("com_units"),
        (F.col("res_units") + F.col("com_units")).cast("string").alias("tot_units"),
        text["land_area"].alias("land_area"),
        text["gross_area"].alias("gross_area"),
        text["yr_built"].alias("yr_built"),
        text["tax_class_sale"].alias("tax_class_sale"),
        text["bldg_class_sale"].alias("bldg_class_sale"),
        text["price"].alias("price"),
        F.date_format("sale_ts", "yyyy-MM-dd HH:mm:ss").alias("sale_ts"),
    )

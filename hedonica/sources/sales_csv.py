"""Reading the raw sales file and exporting a table as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hedonica.fixed_values import RAW_COLUMNS, RAW_NUMBERS


# Standard quoting: fields with quotes, commas or line breaks are quoted, quotes doubled.
QUOTING = {"header": True, "nullValue": "NA", "quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, names: list[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """A CSV with a header, every column as text, NA as missing; no inference pass.

    ``names`` give the columns by position. ``multi_line`` allows line breaks inside quoted
    fields; files can't be split over tasks then, so it is off unless asked for.
    """
    reader = spark.read.options(**QUOTING, multiLine=multi_line)
    if names is None:
        return reader.csv(path)
    found = len(reader.csv(path).columns)
    if found != len(names):
        raise ValueError(f"{len(names)} names for {found} columns")
    schema = StructType([StructField(n, StringType()) for n in names])
    return reader.option("enforceSchema", True).schema(schema).csv(path)


def rename_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    if len(df.columns) != len(names):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def read_sales(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """The raw sales file: 22 columns named by position, counts and codes as numbers."""
    text = read_csv(spark, path, RAW_COLUMNS, multi_line)
    return text.select(
        *[F.col(c).try_cast(RAW_NUMBERS[c]).alias(c) if c in RAW_NUMBERS else F.col(c)
          for c in RAW_COLUMNS]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; blanks inside text are kept as they are.

    The text ``NA`` reads back as missing, which the file has no other sign for.
    """
    (
        df.write.options(**QUOTING)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_exported(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = False
) -> DataFrame:
    """Read back a table exported by ``write_csv`` with its known schema.

    ``multi_line`` is needed if a text holds line breaks; each file is then one task.
    """
    return spark.read.schema(schema).options(**QUOTING, multiLine=multi_line).csv(path)


def read_checked(spark: SparkSession, path: str, names: list[str], header: bool = True) -> DataFrame:
    """``file, line, reason`` and the named columns, for every line: no row is changed silently.

    ``reason`` is NULL for good lines; others have a quote that isn't closed, or another number of
    fields than ``names``, and NULL in all columns. One scan; fields can't hold line breaks.
    With ``header``, lines equal to the first line of the files are no rows; nor are blank lines,
    as in ``read_csv``.
    """
    bad = fresh_name("_bad", names)
    options = {**QUOTING, "header": False, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    options = {k: str(v) for k, v in options.items()}
    text = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("line"))
    lines = text.where(F.trim("line") != "")
    if header and (first := spark.read.text(path).first()) is not None:
        lines = lines.where(F.col("line") != first["value"])
    ddl = ", ".join(f"`{n}` string" for n in [*names, bad])
    parsed = lines.withColumn("row", F.from_csv("line", ddl, options))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    reason = F.when(quotes % 2 == 1, "open quote").when(F.col("row")[bad].isNotNull(), "number of fields")
    judged = parsed.withColumn("reason", reason)
    values = [F.when(F.col("reason").isNull(), F.col("row")[n]).alias(n) for n in names]
    return judged.select("file", "line", "reason", *values)


def fresh_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("file", "line", "reason")


def rejected_rows(checked: DataFrame) -> DataFrame:
    """``file, reason, line`` of what ``good_rows`` leaves out."""
    return checked.where(F.col("reason").isNotNull()).select("file", "reason", "line")


def intake(checked: DataFrame) -> DataFrame:
    """``file, n_lines, n_good, n_rejected``: every line of a file is one or the other."""
    return checked.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("reason").isNull()).alias("n_good"),
        F.count_if(F.col("reason").isNotNull()).alias("n_rejected"),
    )

"""States that are kept for each slice of the data (a day, a load) and put together when read."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def save_slice(state: DataFrame, path: str, name: str) -> None:
    """Save a slice's state below ``path``; the same name again replaces it, so a load that is
    run twice counts once."""
    state.write.mode("overwrite").parquet(f"{path}/slice={quote(name, safe='')}")


def saved_slices(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The states of all slices below ``path``, with the slice's name."""
    return spark.read.schema(f"{schema}, slice string").parquet(path)

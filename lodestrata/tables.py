"""Reading of the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Readers select their columns at once, so only these reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_to_null(col: Column) -> Column:
    """An empty string stands for no value."""
    return F.when(col != "", col)


def utc_month(ts: Column) -> Column:
    """The UTC month of a timestamp as yyyy-MM, whatever time zone the session has."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM")

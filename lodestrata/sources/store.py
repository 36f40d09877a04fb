"""Stores of the index as Parquet: full, incremental, and text output with a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_full(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A table; columns that were added later are null in older files."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def save_incremental(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame, key: str, target: str) -> None:
    """Write ``target``: the table without the keys that are gone or fresh, and the fresh rows.

    The old table stays until readers move on to the new one, so a lost job loses nothing.
    """
    old = spark.read.parquet(path)
    out = gone.select(key).unionByName(fresh.select(key)).distinct()
    old.join(out, key, "left_anti").unionByName(fresh.select(*old.columns)).write.mode("overwrite").parquet(target)


def append_events(df: DataFrame, path: str) -> None:
    """Append ranking events: the query becomes the beginning of its digest, the first 50 ids stay."""
    rows = df.withColumn("query_hash", F.substring(F.sha1("query"), 1, 16)).withColumn("returned_ids", F.slice("returned_ids", 1, 50))
    rows.write.mode("append").parquet(path)


def compact_lines(df: DataFrame, interned: str) -> DataFrame:
    """line: rows as tab-separated text in which values of one column are numbers, and a legend line for each number.

    The numbers are dense ranks of the distinct values; legend lines begin with @.
    """
    from pyspark.sql import Window

    legend = df.select(interned).distinct().withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(interned)))
    rows = df.join(legend, interned)
    text = F.concat_ws("\t", *(F.coalesce(("n" if c == interned else F.regexp_replace(F.col(c).cast("string"), r"[\t\n]", " ")), F.lit("")) if c != interned else F.col("n").cast("string") for c in df.columns))
    return legend.select(F.concat(F.lit("@"), F.col("n").cast("string"), F.lit("="), F.col(interned)).alias("line")).unionByName(rows.select(text.alias("line")))

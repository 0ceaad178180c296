"""Small configuration files read whole, from any store Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def read_whole(spark: SparkSession, folder: str, pattern: str) -> list[tuple[str, str]]:
    """(name, text) of each file of a folder, in name order. For files written by hand: they come to the driver."""
    files = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_name").alias("name"), "value").collect()
    return sorted((r["name"], r["value"]) for r in rows)

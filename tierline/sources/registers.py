"""CSV registers and inspection files (every column stays text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_blocks import BOM, read_quoted_csv

def _read_csv(spark: SparkSession, path, encoding: str, splittable: bool) -> DataFrame:
    """Every column as text; quoted values may hold line breaks, and a large file is read by many tasks.

    ``splittable`` is for files known to have no line break inside quotes:
    Spark's own reader then cuts them at any line.
    """
    if not splittable:
        return read_quoted_csv(spark, path, encoding)
    df = spark.read.csv(
        path,
        header=True,
        encoding=encoding,
        mode="PERMISSIVE",  # short rows are padded with nulls, long ones cut
        quote='"',
        escape='"',
    )
    return df.toDF(*[c.replace(BOM, "").strip() if c.startswith(BOM) else c for c in df.columns])


def read_register(spark: SparkSession, path, splittable: bool = False) -> DataFrame:
    """School register, Latin-1."""
    return _read_csv(spark, path, "ISO-8859-1", splittable)


def read_inspections_csv(spark: SparkSession, path, splittable: bool = False) -> DataFrame:
    """Inspection file, UTF-8 with or without a byte-order mark."""
    return _read_csv(spark, path, "UTF-8", splittable)


def latest_snapshot(spark: SparkSession, folder: str) -> str:
    """Path of the CSV with the greatest file name.

    Only the listing is read (``binaryFile`` without its content column).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    newest = files.agg(F.max_by("path", F.substring_index("path", "/", -1)).alias("path")).first()
    if newest["path"] is None:
        raise FileNotFoundError(f"no CSV under {folder}")
    return newest["path"]


def read_provider_register(spark: SparkSession, folder: str, splittable: bool = False) -> DataFrame:
    """The newest approved-provider file of a landing folder."""
    return _read_csv(spark, latest_snapshot(spark, folder), "UTF-8", splittable)

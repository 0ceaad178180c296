"""A stored ranking: any page is a seek, however deep."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


@dataclass(frozen=True)
class RankedTable:
    """Rows with their ``place`` (from 0), stored by ranges of places under ``path``.

    ``firsts`` holds the first place of each range, as many numbers as there
    are ranges; they are kept beside the rows, so a page needs no count.
    """

    spark: SparkSession
    path: str
    firsts: tuple[int, ...]
    total: int

    @staticmethod
    def build(df: DataFrame, order: Sequence[Column], path: str, ranges: int | None = None) -> RankedTable:
        """Rank ``df`` by ``order``, whose last column must be unique: then ties have one order and any range can be cut.

        One exchange by range; each range is numbered in its own task, from the
        number of rows in the ranges before it.
        """
        spark = df.sparkSession
        ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = cut_lineage(df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
        sizes = dealt.groupBy("range").count().withColumn("first", F.expr("sum(count) OVER (ORDER BY range) - count"))
        sizes = cut_lineage(sizes, "range-sizes")  # one row for each range
        inner = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
        placed = dealt.withColumn("place", inner.cast("long")).join(F.broadcast(sizes.select("range", "first")), "range")
        rows = placed.withColumn("place", F.col("place") + F.col("first")).drop("first")
        rows.write.partitionBy("range").parquet(f"{path}/rows")
        sizes.write.parquet(f"{path}/ranges")
        return RankedTable.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> RankedTable:
        sizes = spark.read.parquet(f"{path}/ranges").orderBy("range").collect()
        # a range without rows is no folder; its number is kept by repeating the next first place
        firsts, n = [], 0
        for r in sizes:
            while len(firsts) <= r["range"]:
                firsts.append(n)
            n += r["count"]
        return RankedTable(spark, path, tuple(firsts), n)

    def after(self, place: int, size: int) -> DataFrame:
        """The ``size`` rows that follow the row at ``place`` (-1: from the start), in order, with their places."""
        begin, end = place + 1, min(place + 1 + size, self.total)
        rows = self.spark.read.parquet(f"{self.path}/rows") if self.total else None
        if rows is None:
            raise ValueError("the ranking is empty")
        low, high = bisect_right(self.firsts, begin) - 1, bisect_right(self.firsts, max(begin, end - 1)) - 1
        held = rows.where(F.col("range").between(low, high)).where((F.col("place") >= begin) & (F.col("place") < end))
        return held.drop("range").orderBy("place")

    def page(self, number: int, size: int = 30) -> DataFrame:
        """Page ``number`` (from 1)."""
        return self.after((max(1, number) - 1) * size - 1, size)

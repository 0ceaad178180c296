"""A stored index of character grams: LIKE searches that read what the pattern asks for, not the table."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage

GRAM = 3
#: Begin and end of a text, so that patterns without a % there are asked for by it.
EDGES = ("\x02", "\x03")
#: Rarest grams of a pattern that are intersected.
ASKED = 3


def pattern_grams(pattern: str) -> set[str]:
    """Grams that every text like ``pattern`` (case folded already; backslash escapes) must hold."""
    runs, run, at = [], EDGES[0], 0
    while at < len(pattern):
        char = pattern[at]
        if char in "%_":
            runs.append(run)
            run = ""
        else:
            at += char == "\\" and at + 1 < len(pattern)
            run += pattern[at]
        at += 1
    runs.append(run + EDGES[1])
    return {r[i : i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)}


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class GramIndex:
    """Rows by bucket of their id, and postings (gram, id) by bucket of the gram, under ``path``.

    ``counts`` holds the number of postings of each gram. Postings are rows in
    the order of gram and id, cut by ranges of both, so a gram that most texts
    hold is no larger task than others. Null texts are like nothing.
    """

    spark: SparkSession
    path: str
    id: str
    text: str
    buckets: int

    @staticmethod
    def build(df: DataFrame, id: str, text: str, path: str, buckets: int = 64) -> GramIndex:
        rows = df.withColumn("row_bucket", _bucket(F.col(id), buckets))
        rows.repartition("row_bucket", F.pmod(F.xxhash64(text), F.lit(4))).write.partitionBy("row_bucket").parquet(f"{path}/rows")
        spark = df.sparkSession
        stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        edged = F.concat(F.lit(EDGES[0]), F.lower(text), F.lit(EDGES[1]))
        grams = F.array_distinct(F.regexp_extract_all(edged, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))
        held = stored.select(F.col(id).alias("id"), "row_bucket", F.explode_outer(grams).alias("gram")).where(F.col("gram").isNotNull())
        held = held.withColumn("bucket", _bucket(F.col("gram"), buckets))
        order = ["bucket", "gram", "id"]
        held.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("bucket").parquet(f"{path}/postings")
        postings = spark.read.schema(held.schema).parquet(f"{path}/postings")
        counted = postings.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n"))
        counted.repartitionByRange("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
        spark.createDataFrame([(id, text, buckets, rows.schema.json(), held.schema.json())], "id string, text string, buckets int, rows string, postings string").write.parquet(f"{path}/meta")
        return GramIndex(spark, path, id, text, buckets)

    @staticmethod
    def open(spark: SparkSession, path: str) -> GramIndex:
        return GramIndex(spark, path, *spark.read.parquet(f"{path}/meta").select("id", "text", "buckets").first())

    def _read(self, part: str) -> DataFrame:
        """A part by its stored schema (an index of no rows has no files)."""
        if part == "counts":
            schema = "gram string, n bigint, bucket int"
        else:
            schema = StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.path}/meta").first()[part]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def _of(self, part: str, grams: Sequence[str]) -> DataFrame:
        """Rows of some grams; reads their buckets only, and in these what the sorted files leave."""
        frame = self.spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("g")).select(_bucket(F.col("g"), self.buckets))
        buckets = sorted({r[0] for r in frame.collect()})  # at most one for each gram of the patterns
        return self._read(part).where(F.col("bucket").isin(buckets) & F.col("gram").isin(list(grams)))

    def candidates(self, patterns: Sequence[str]) -> DataFrame | None:
        """(id, row_bucket) of the texts that hold the rarest grams of some pattern; None if a pattern has no gram."""
        folded = self.spark.range(1).select(*[F.lower(F.lit(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).first()
        asked = [pattern_grams(p) for p in folded]
        if not all(asked):
            return None
        known = {r.gram: r.n for r in self._of("counts", sorted(set().union(*asked))).collect()}  # one for each asked gram
        # a pattern with a gram that no text holds is like none
        rarest = [sorted(grams, key=lambda g: (known[g], g))[:ASKED] for grams in asked if grams <= known.keys()]
        if not rarest:
            return self._read("postings").where(F.lit(False)).select("id", "row_bucket")
        found = self._of("postings", sorted(set().union(*rarest)))
        if all(len(grams) == 1 for grams in rarest):
            return found.select("id", "row_bucket").distinct()
        holds = [reduce(lambda a, b: a & b, [F.max(F.col("gram") == g) for g in grams]) for grams in rarest]
        return found.groupBy("id", "row_bucket").agg(reduce(lambda a, b: a | b, holds).alias("all")).where("all").select("id", "row_bucket")

    def search(self, patterns: Sequence[str]) -> DataFrame:
        """Rows whose text is like any of the patterns, in any case; every row found is tested on its whole text.

        Patterns too short for a gram are tested on all rows.
        """
        rows = self._read("rows")
        if not patterns:
            return rows.where(F.lit(False)).drop("row_bucket")
        like = reduce(lambda a, b: a | b, [F.col(self.text).ilike(p) for p in patterns])
        candidates = self.candidates(patterns)
        if candidates is not None:
            candidates = cut_lineage(candidates, "candidates")
            buckets = [r[0] for r in candidates.select("row_bucket").distinct().collect()]  # at most self.buckets numbers
            rows = rows.where(F.col("row_bucket").isin(buckets))
            rows = rows.join(candidates.select(F.col("id").alias("__id")), rows[self.id].eqNullSafe(F.col("__id")), "left_semi")
        return rows.where(like).drop("row_bucket")

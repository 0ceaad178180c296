"""Shared helpers: stored intermediate tables, ranks without a single task, connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.session import cut_lineage, scratch_dir

__all__ = ["components", "cut_lineage", "lower_ascii", "ranked", "scratch_dir", "slices", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 512):
    """Arrow batches in slices, so that Python holds the texts of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lower_ascii(column):
    """Lower-case A to Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def ranked(df: DataFrame, group: str, order: Iterable[str], rank: str = "rank") -> DataFrame:
    """``df`` with the 0-based, gapless rank of each row within ``group``, by ``order``.

    The rows are dealt out by range of (group, order), so one group may spread over any number of tasks; only the
    number of rows of each (task, group) meets on the way, and each task then counts on from the rows before it. The
    dealt rows are stored once, since a range exchange samples its bounds and must not be run twice.
    """
    keys = [group, *order]
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut_lineage(
        df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()),
        "ranked",
    )
    inner = F.expr(
        f"row_number() OVER (PARTITION BY `{group}`, __part ORDER BY {', '.join(f'`{c}`' for c in order)}) - 1"
    )
    sizes = dealt.groupBy(group, "__part").agg(F.count("*").alias("__n"))
    before = F.expr(
        f"coalesce(sum(__n) OVER (PARTITION BY `{group}` ORDER BY __part "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    offsets = sizes.select(F.col(group).alias("__group"), F.col("__part").alias("__of"), before.alias("__before"))
    return (
        dealt.withColumn("__inner", inner)
        .join(offsets, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__of")))
        .withColumn(rank, (F.col("__inner") + F.col("__before")).cast("long"))
        .drop("__group", "__of", "__before", "__inner", "__part")
    )


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Each round every id takes the smallest label among its own and its neighbours' labels (one aggregate with map-side
    combine, so an id with very many links is no hot group), then jumps to its label's label. Labels are stored after
    each round; the number of rounds grows with the logarithm of the longest path. Ids without links are not listed.

    Before the rounds an id that is linked to several smaller ones keeps the link to the smallest, and the others are
    linked to that one instead: what hangs together stays so, and the many links of members to a few centres shrink.
    """
    down = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), label
    )
    least = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")), label)
    others = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v != m")
    fewer = least.select(F.col("u").alias("a"), F.col("m").alias("b")).union(others.select("v", "m"))
    both = cut_lineage(fewer.union(fewer.select("b", "a")).distinct(), label)
    labels = cut_lineage(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")),
        label,
    )
    while True:
        near = (
            both.join(labels, both["b"] == labels["id"])
            .groupBy("a")
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, labels["id"] == near["a"]).select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("new")
        )
        up = labels.select(F.col("id").alias("up"), F.col("component").alias("top"))
        after = cut_lineage(
            hooked.join(up, hooked["new"] == up["up"], "left").select(
                "id", F.least("new", "top").alias("component"), "old"
            ),
            label,
        )
        if after.where("component != old").limit(1).count() == 0:
            return after.select("id", "component")
        labels = after.select("id", "component")

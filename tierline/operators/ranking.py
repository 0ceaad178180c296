"""Top-n per key, latest rows, ordering and paging.

``row_number() <= n`` right after the window lets Spark place a partial
WindowGroupLimit before the exchange: every task ships at most n rows per key,
so a key that owns a third of the table is cut down where it is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

_RN = "__rn"


def top_n_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None, rank_as: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every key (None: all of them); ``rank_as`` keeps the position."""
    if n is None and rank_as is None:
        return df
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(_RN, F.row_number().over(w))
    kept = kept if n is None else kept.where(F.col(_RN) <= n)
    return kept.drop(_RN) if rank_as is None else kept.withColumnRenamed(_RN, rank_as)


def latest_per(df: DataFrame, key: str, date: str, id_: str = "id") -> DataFrame:
    """Newest row per key; among equal dates the lowest id."""
    return top_n_per(df, [key], [F.col(date).desc(), F.col(id_).asc()], 1)


def with_previous(df: DataFrame, key: str, date: str, columns: Sequence[str], id_: str = "id") -> DataFrame:
    """Latest row with the named columns of the one before it as ``previous_*``.

    Two rows per key survive the scan; they are folded by an aggregate.
    """
    two = top_n_per(df, [key], [F.col(date).desc(), F.col(id_).asc()], 2, rank_as=_RN)
    newest, older = F.col(_RN) == 1, F.col(_RN) == 2
    whole = F.struct(*[F.col(c) for c in df.columns])
    folded = two.groupBy(key).agg(
        F.max(F.when(newest, whole)).alias("n"),
        *[F.max(F.when(older, F.col(c))).alias(f"previous_{c}") for c in columns],
    )
    return folded.select("n.*", *[f"previous_{c}" for c in columns])


def latest_value(df: DataFrame, key: str, date: str, column: str, id_: str = "id") -> DataFrame:
    """(key, column) of the newest row, as an aggregate with map-side combine."""
    order = F.struct(F.col(date), -F.col(id_))
    return df.groupBy(key).agg(F.max_by(F.col(column), order).alias(column))


def latest_with_children(parents: DataFrame, children: DataFrame, key: str, date: str, child_key: str) -> DataFrame:
    """Newest parent per key among those that have any child row."""
    owners = children.select(F.col(child_key).alias("id")).distinct()
    return latest_per(parents.join(owners, "id", "left_semi"), key, date)


def latest_run_per_source(runs: DataFrame) -> DataFrame:
    return top_n_per(runs, ["source"], [F.col("started_at").desc(), F.col("id").desc()], 1)


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return top_n_per(df, keys, [F.col(order).asc()], 1)


def dedupe_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return top_n_per(df, keys, [F.col(order).desc()], 1)


def desc_nulls_last(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def page(df: DataFrame, number: int, order: Sequence[Column], size: int = 30) -> DataFrame:
    """Page ``number`` (from 1) in the given order."""
    start = (max(1, number) - 1) * size
    return df.orderBy(*order).offset(start).limit(size)


def list_position(col: Column, values: Sequence[str]) -> Column:
    """Position in a given list; values outside it come last."""
    out: Column = F.lit(len(values))
    for i in reversed(range(len(values))):
        out = F.when(col == values[i], i).otherwise(out)
    return out

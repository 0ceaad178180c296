"""Stored tables cut into buckets of their key: a change reads and writes only the buckets it touches.

The table is Parquet under ``bucket=<b>`` folders, and a write replaces whole buckets by Spark's dynamic partition
overwrite. What replaces them is stored first, so the write reads nothing it replaces, and since every change here
gives the same rows when it is applied again, a run that was cut off is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .upsert import replace_children, upsert

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketedTable:
    """``schema`` (DDL) at ``path``, cut by a hash of ``keys`` into ``buckets``.

    The keys may be some of a row's whole key, so that a change that knows only
    those still finds its buckets. Rows with a null key are spread by a hash of
    the whole row: no upsert finds them again, so they need no place of their own.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 1024

    def bucket(self, columns: Sequence[str]) -> Column:
        complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        spread = F.when(complete, F.xxhash64(*self.keys)).otherwise(F.xxhash64(*columns))
        return F.pmod(spread, F.lit(self.buckets)).cast("int")

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The rows, of the buckets ``only`` if given (no other folder is listed for reading)."""
        try:
            rows = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"{self.schema}, {BUCKET} int")
        if only is not None:
            rows = rows.where(F.col(BUCKET).isin([int(b) for b in only]))
        return rows.drop(BUCKET)

    def shaped(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the table's types: equal keys must hash alike."""
        types = dict(self.read([]).dtypes)
        return rows.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in rows.columns])

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of ``rows``: at most ``buckets`` numbers."""
        rows = self.shaped(rows)
        return sorted(r[0] for r in rows.select(self.bucket(rows.columns).alias(BUCKET)).distinct().collect())

    def write(self, rows: DataFrame, replaced: Sequence[int] | None = None) -> None:
        """Put ``rows`` in place of all rows of the buckets ``replaced`` (default: of their own buckets).

        AQE cuts a bucket that one key fills into several files.
        """
        rows = self.shaped(rows.select(*self.read([]).columns))
        dealt = cut_lineage(rows.withColumn(BUCKET, self.bucket(rows.columns)).hint("rebalance", BUCKET), "buckets")
        if replaced is not None:
            present = {r[0] for r in dealt.select(BUCKET).distinct().collect()}
            if present - set(replaced):
                raise ValueError(f"rows outside of the buckets that were read: {sorted(present - set(replaced))}")
            self._empty(set(replaced) - present)
        dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(BUCKET).parquet(self.path)

    def _empty(self, buckets: set[int]) -> None:
        """A dynamic overwrite leaves buckets without new rows alone, so those are removed."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.path)
        store = root.getFileSystem(context._jsc.hadoopConfiguration())
        for b in sorted(buckets):
            store.delete(context._jvm.org.apache.hadoop.fs.Path(root, f"{BUCKET}={b}"), True)

    def change(self, touched: Sequence[int], apply: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the ``touched`` buckets by what ``apply`` makes of their rows; returns them."""
        if touched:
            self.write(apply(self.read(touched)), touched)
        return list(touched)

    def upsert(
        self, source: DataFrame, keys: Sequence[str], overwrite: Sequence[str] = (), keep_if_null: Sequence[str] = (), order: str | None = None
    ) -> list[int]:
        """:func:`upsert` into the buckets of ``source``'s keys. Rows with a null key are inserted anew each time."""
        columns = self.read([]).columns
        offered = [c for c in source.columns if c in columns or c == order]
        # stored: it is asked for its buckets, then joined
        source = cut_lineage(self.shaped(source.select(*offered)), "upsert-source")
        whole = source.select(*[F.col(c) if c in offered else F.lit(None).alias(c) for c in columns])
        return self.change(self.touched(whole), lambda target: upsert(target, source, keys, overwrite, keep_if_null, order))

    def replace_children(self, new: DataFrame, parents: DataFrame) -> list[int]:
        """:func:`replace_children` for the table's key: the children of ``parents`` become ``new``."""
        (key,) = self.keys
        done = parents.select(key).distinct()
        new = new.select(*self.read([]).columns)
        touched = sorted({*self.touched(done), *self.touched(new)})
        return self.change(touched, lambda target: replace_children(target, new, done, key))

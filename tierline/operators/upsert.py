"""Keyed upsert, child replacement, versions and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(*columns: str) -> list[Column]:
    """Each column with a mark that says whether it is null: the hash itself skips nulls."""
    return [x for c in columns for x in (F.col(c).isNull(), F.col(c))]


def surrogate_id(kind: str, *columns: str) -> Column:
    """Deterministic 62-bit id of a natural key (stable under task retries).

    Bit 62 is always set, which keeps the ids clear of small sequence numbers.
    Meant for dimensions; a fact of 10^9 rows and more takes :func:`wide_id`.
    """
    low = F.xxhash64(F.lit(kind), *_marked(*columns)).bitwiseAND(F.lit((1 << 62) - 1))
    return low.bitwiseOR(F.lit(1 << 62))


def wide_id(kind: str, *columns: str) -> Column:
    """Deterministic 122-bit id of a natural key as DECIMAL(38, 0).

    Two hashes with different marks make its halves: 10^11 keys collide with
    a probability near 10^-15.
    """
    high = F.xxhash64(F.lit(kind), F.lit("high"), *_marked(*columns)).bitwiseAND(F.lit((1 << 60) - 1))
    low = F.xxhash64(*_marked(*columns), F.lit("low"), F.lit(kind)).bitwiseAND(F.lit((1 << 62) - 1))
    whole = high.cast("decimal(20, 0)") * F.lit(1 << 62).cast("decimal(19, 0)") + low.cast("decimal(20, 0)")
    return whole.cast("decimal(38, 0)")


_ROW = "__row"


def fold_source(
    source: DataFrame, keys: Sequence[str], overwrite: Sequence[str], keep_if_null: Sequence[str], order: str
) -> DataFrame:
    """Several source rows of one key -> the row that applying them in order leaves.

    The first row inserts, later ones update the named columns only; so the
    other columns come from the first row, ``overwrite`` from the last, and
    ``keep_if_null`` from the last that has a value. One aggregate: partial
    results are merged before the exchange, whatever the key's share.
    """
    named = set(overwrite) | set(keep_if_null) | set(keys) | {order}
    rest = [c for c in source.columns if c not in named]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in keep_if_null]
    if overwrite:
        aggs.append(F.max_by(F.struct(*overwrite), F.col(order)).alias("__last"))
    if rest:
        aggs.append(F.min_by(F.struct(*rest), F.col(order)).alias("__first"))
    folded = source.groupBy(*keys).agg(*aggs)
    return folded.select(
        *keys,
        *keep_if_null,
        *(["__last.*"] if overwrite else []),
        *(["__first.*"] if rest else []),
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    overwrite: Sequence[str] = (),
    keep_if_null: Sequence[str] = (),
    order: str | None = None,
    null_keys: bool = False,
) -> DataFrame:
    """Insert new keys, update the named columns of known ones.

    ``overwrite`` columns take the source value, ``keep_if_null`` columns only
    when it is not null, all other columns of a known row stay. With ``order``
    the source may repeat keys (see :func:`fold_source`). A null in a key never
    matches: such source rows are all inserted and such target rows stay.
    ``null_keys`` says that nulls are common; they are then spread over all
    tasks by a hash of the row instead of meeting in one.
    """
    columns, types = target.columns, dict(target.dtypes)
    overwrite = [c for c in overwrite if c in source.columns]
    keep_if_null = [c for c in keep_if_null if c in source.columns]
    source = source.select(*[c for c in source.columns if c in columns or c == order])
    join_keys = list(keys)
    if null_keys:
        complete = F.lit(True)
        for k in keys:
            complete = complete & F.col(k).isNotNull()

        def spread(df: DataFrame) -> DataFrame:
            return df.withColumn(_ROW, F.when(complete, F.lit(0)).otherwise(F.xxhash64(*df.columns)))

        target, source = spread(target), spread(source)
        join_keys.append(_ROW)
    if order is not None:
        source = fold_source(source, join_keys, overwrite, keep_if_null, order)
    offered = [c for c in source.columns if c not in join_keys and c in columns]
    left = target.withColumn("__known", F.lit(True))
    right = source.select(
        *join_keys, *[F.col(c).alias(f"__new_{c}") for c in offered], F.lit(True).alias("__seen")
    )
    joined = left.join(right, join_keys, "full_outer")

    def merged(c: str) -> Column:
        if c not in offered:
            return F.col(c)
        new = F.col(f"__new_{c}")
        if c in overwrite:
            return F.when(F.col("__seen"), new).otherwise(F.col(c))
        if c in keep_if_null:
            return F.coalesce(new, F.col(c))
        return F.when(F.col("__known"), F.col(c)).otherwise(new)

    return joined.select(*[merged(c).cast(types[c]).alias(c) for c in columns])


def replace_children(target: DataFrame, new: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children of the re-processed ``parents`` replaced, all others kept.

    ``parents`` lists what was re-processed, so a parent whose new child set
    is empty still loses its old children.
    """
    done = parents.select(parent_key).distinct()
    return target.join(done, parent_key, "left_anti").select(*target.columns).unionByName(new.select(*target.columns))


def register_version(versions: DataFrame, sha256: str, phrase_count: int) -> DataFrame:
    """Append the library hash only when it has not been seen."""
    spark = versions.sparkSession
    new = spark.createDataFrame([(sha256, phrase_count)], "yaml_hash string, phrase_count int")
    unseen = new.join(versions.select("yaml_hash"), "yaml_hash", "left_anti")
    return versions.unionByName(unseen, allowMissingColumns=True)


def content_manifest(docs: DataFrame, as_of: str, max_age_hours: float, url: str = "url", body: str = "body", fetched_at: str = "fetched_at") -> DataFrame:
    """url, bytes, sha256, fetched_at and whether the copy is still fresh."""
    data = F.col(body).cast("binary")
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(fetched_at).cast("timestamp"))
    return docs.select(
        url,
        F.octet_length(data).cast("bigint").alias("bytes"),
        F.sha2(data, 256).alias("sha256"),
        F.col(fetched_at).alias("fetched_at"),
        (age < F.lit(max_age_hours * 3600)).alias("fresh"),
    )

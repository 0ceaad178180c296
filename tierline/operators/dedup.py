"""Entity resolution: clusters, canonical rows, survivorship, re-pointing.

A name key may own a third of the table, so a cluster is never gathered: it is
one aggregate row (counts, extremes, winners), and members meet it by a join
whose cluster side has one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import norm_name
from ..functions.text import non_blank, present
from .ranking import top_n_per

# ---- fixed values ---------------------------------------------------------
MIN_KEY = 6
SCHOOL_TYPES = ["state_school", "independent_school"]
TRAINING_TYPES = ["itp", "fe_college"]
FILLED_FIELDS = [
    "ukprn", "urn", "isi_id", "postcode", "website", "general_email", "head_email", "apprenticeship_standards",
]
# ---------------------------------------------------------------------------


def _filled(name: str) -> Column:
    if name == "apprenticeship_standards":
        return F.coalesce(F.col(name) != 0, F.lit(False))
    return present(F.col(name))


def completeness() -> Column:
    points = [("urn", 5), ("ukprn", 3), ("website", 1), ("general_email", 1), ("postcode", 1)]
    total = sum((F.when(_filled(f), p).otherwise(0) for f, p in points), F.lit(0))
    return total + F.when(F.col("apprenticeship_standards") > 0, 1).otherwise(0)


def keyed_members(institutions: DataFrame) -> DataFrame:
    return (
        institutions.where(F.col("in_scope"))
        .withColumn("cluster_key", norm_name(F.col("name"), "dedup"))
        .where(F.length("cluster_key") >= MIN_KEY)
    )


def find_clusters(institutions: DataFrame) -> DataFrame:
    """One row per shared name key: size, guard facts and the canonical id.

    The only row with a URN is canonical, else the most complete, lowest id.
    "More than one postcode" is min < max: no set is collected.
    """
    place = non_blank(F.upper(F.regexp_replace("postcode", r"\s", "")))
    with_urn = _filled("urn")
    best = F.struct(completeness(), -F.col("id"))
    clusters = (
        keyed_members(institutions)
        .groupBy("cluster_key")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.coalesce(F.min(place) < F.max(place), F.lit(False)).alias("postcodes_differ"),
            (
                F.max(F.col("type").isin(*SCHOOL_TYPES)) & F.max(F.col("type").isin(*TRAINING_TYPES))
            ).alias("types_mixed"),
            F.when(F.count_if(with_urn) == 1, F.min(F.when(with_urn, F.col("id"))))
            .otherwise(F.max_by("id", best))
            .alias("canonical_id"),
        )
    )
    return clusters.where(F.col("size") > 1)


def guard_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters that may be merged: one postcode at most, compatible types."""
    return clusters.where(~F.col("postcodes_differ") & ~F.col("types_mixed"))


def pick_canonical(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_key", "canonical_id")


def id_map(institutions: DataFrame) -> DataFrame:
    """loser id -> canonical id of every mergeable cluster."""
    merged = pick_canonical(guard_clusters(find_clusters(institutions)))
    members = keyed_members(institutions).select("id", "cluster_key")
    return (
        members.join(merged, "cluster_key")
        .where(F.col("id") != F.col("canonical_id"))
        .select(F.col("id").alias("loser_id"), "canonical_id")
    )


def survivorship(institutions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Canonical rows with their blanks filled, losers removed.

    Losers are applied in id order against the canonical row as it was read,
    so for each field that was blank the last loser with a value wins. Zero
    standards and empty text are blanks. Tags are merged by the same rule: the
    last loser whose tags would change the set decides.
    """
    losers = institutions.join(mapping, F.col("id") == F.col("loser_id"))
    own = institutions.select(F.col("id").alias("canonical_id"), F.col("source").alias("__own_source"))
    offered = losers.groupBy("canonical_id").agg(
        *[
            F.max_by(F.col(f), F.when(_filled(f), F.col("loser_id"))).alias(f"__fill_{f}") for f in FILLED_FIELDS
        ]
    )
    own_tags = F.filter(F.split(F.coalesce("__own_source", F.lit("")), r"\+"), lambda t: t != "")
    loser_tags = F.filter(F.split("source", r"\+"), lambda t: t != "")
    union = F.array_join(F.array_distinct(F.concat(own_tags, loser_tags)), "+")
    tagged = (
        losers.where(_filled("source"))
        .groupBy("canonical_id", "source")
        .agg(F.max("loser_id").alias("loser_id"))
        .join(own, "canonical_id")
        .withColumn("__union", union)
        .where(
            (F.col("source") != F.coalesce("__own_source", F.lit("")))
            & (F.col("__union") != F.coalesce("__own_source", F.lit("")))
        )
        .groupBy("canonical_id")
        .agg(F.max_by("__union", "loser_id").alias("__fill_source"))
    )
    changes = offered.join(tagged, "canonical_id", "left").withColumnRenamed("canonical_id", "id")
    kept = institutions.join(mapping, F.col("id") == F.col("loser_id"), "left_anti")
    filled = kept.join(changes, "id", "left")

    def merged(c: str) -> Column:
        if c == "source":
            return F.coalesce("__fill_source", F.col(c)).alias(c)
        if c in FILLED_FIELDS:
            return F.when(_filled(c), F.col(c)).otherwise(F.coalesce(f"__fill_{c}", F.col(c))).alias(c)
        return F.col(c)

    return filled.select(*[merged(c) for c in institutions.columns])


def repoint(child: DataFrame, mapping: DataFrame, unique_key: Sequence[str] | None = None) -> DataFrame:
    """Children of losers moved to the canonical row.

    With a ``unique_key`` (columns besides institution_id) colliding rows are
    dropped: the canonical row's own child stays, else the one of the first
    loser. Scores are not moved but dropped: use :func:`drop_losers`.
    """
    moved = child.join(mapping, F.col("institution_id") == F.col("loser_id"), "left").withColumns(
        {
            "__loser": F.col("loser_id"),
            "institution_id": F.coalesce("canonical_id", "institution_id"),
        }
    )
    if unique_key is None:
        return moved.select(*child.columns)
    order = [F.col("__loser").asc_nulls_first(), F.col("id").asc()]
    kept = top_n_per(moved, ["institution_id", *unique_key], order, 1)
    return kept.select(*child.columns)


def drop_losers(child: DataFrame, mapping: DataFrame) -> DataFrame:
    return child.join(mapping, F.col("institution_id") == F.col("loser_id"), "left_anti")

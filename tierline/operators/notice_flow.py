"""Notices kept current: register snapshots, feeds, notice lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notices import (
    classify_feed_entry,
    classify_notice_title,
    classify_register_status,
    name_candidates,
    severity_for,
)
from ..functions.text import present, strip
from .buckets import BucketedTable
from .joins import lookup
from .matching import match_by_name
from .ranking import dedupe_last
from .upsert import surrogate_id, upsert

# ---- fixed values ---------------------------------------------------------
REGISTER_URL = "https://download.apprenticeships.education.gov.uk/apar"
NOTICE_KEY = ["institution_id", "source_url", "notice_type"]
# ---------------------------------------------------------------------------


def _identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", surrogate_id("notice", *NOTICE_KEY))


def register_notices(register: DataFrame, institutions: DataFrame, as_of: str) -> DataFrame:
    """Register rows (ukprn, application_type, status, determined, row_no) as notices."""
    rows = register.withColumn("ukprn", strip(F.col("ukprn"))).where(present(F.col("ukprn")))
    found = lookup(rows, institutions, "ukprn").withColumn("c", classify_register_status(F.col("status")))
    details = F.concat(
        F.lit("APAR ApplicationType: "), F.col("application_type"), F.lit("; Status: "), F.col("status")
    )
    return _identified(
        found.where(F.col("c").isNotNull()).select(
            "institution_id",
            F.lit("apar").alias("notice_body"),
            F.col("c.notice_type").alias("notice_type"),
            F.coalesce(F.substring("determined", 1, 10), F.lit(as_of)).alias("issued_at"),
            F.lit(None).cast("string").alias("withdrawn_at"),
            severity_for(F.col("c.notice_type")).alias("severity"),
            F.col("c.subject").alias("subject"),
            details.alias("details"),
            F.lit(REGISTER_URL).alias("source_url"),
            "row_no",
        )
    )


def apply_snapshot(notices: DataFrame, snapshot: DataFrame, as_of: str) -> DataFrame:
    """Fold a register snapshot into the notices.

    Seen notices are refreshed and re-opened; open register notices whose
    institution is no longer in the snapshot are withdrawn as of the day.
    """
    merged = upsert(
        notices, snapshot, NOTICE_KEY, overwrite=["severity", "subject", "details", "withdrawn_at"], order="row_no"
    )
    seen = snapshot.select("institution_id").distinct().withColumn("__seen", F.lit(True))
    open_register = (F.col("notice_body") == "apar") & F.col("withdrawn_at").isNull()
    gone = open_register & F.col("__seen").isNull()
    return (
        merged.join(seen, "institution_id", "left")
        .withColumn("withdrawn_at", F.when(gone, as_of).otherwise(F.col("withdrawn_at")))
        .select(*notices.columns)
    )


def apply_snapshot_stored(table: BucketedTable, snapshot: DataFrame, as_of: str) -> list[int]:
    """:func:`apply_snapshot` on notices stored by institution: only touched buckets are read whole and written.

    Touched are the buckets of the snapshot's institutions and of those that
    have an open register notice and are not in it; the latter are found from
    three columns of the table.
    """
    seen = snapshot.select("institution_id").distinct()
    stale = (
        table.read()
        .where((F.col("notice_body") == "apar") & F.col("withdrawn_at").isNull())
        .select("institution_id")
        .distinct()
        .join(seen, "institution_id", "left_anti")
    )
    touched = sorted({*table.touched(seen), *table.touched(stale)})
    return table.change(touched, lambda notices: apply_snapshot(notices, snapshot, as_of))


def feed_notices(entries: DataFrame, institutions: DataFrame, body: str = "govuk") -> DataFrame:
    """Feed entries (title, summary, link, updated, row_no) that concern an institution."""
    classed = entries.withColumn("c", classify_feed_entry(F.col("title"), F.col("summary"))).where(
        F.col("c").isNotNull()
    )
    named = classed.select("*", F.explode(name_candidates(F.col("title"))).alias("candidate"))
    hits = match_by_name(named, institutions, "candidate").where(F.col("institution_id").isNotNull())
    return _identified(
        hits.select(
            "institution_id",
            F.lit(body).alias("notice_body"),
            F.col("c.notice_type").alias("notice_type"),
            F.substring("updated", 1, 10).alias("issued_at"),
            F.lit(None).cast("string").alias("withdrawn_at"),
            severity_for(F.col("c.notice_type")).alias("severity"),
            F.col("title").alias("subject"),
            F.col("summary").alias("details"),
            F.col("link").alias("source_url"),
            "row_no",
        )
    )


def merge_feed_notices(notices: DataFrame, found: DataFrame) -> DataFrame:
    return upsert(notices, found, NOTICE_KEY, overwrite=["subject", "details"], order="row_no")


def list_notices(entries: DataFrame, institutions: DataFrame, as_of: str) -> DataFrame:
    """Notice-list links (href, title, section, row_no) as notices with closed state."""
    unique = dedupe_last(entries, ["href"], "row_no")
    classed = unique.withColumn("c", classify_notice_title(F.col("title"), F.col("section"), as_of)).withColumn(
        "college", F.col("c.college")
    )
    hits = match_by_name(classed, institutions, "college").where(F.col("institution_id").isNotNull())
    return _identified(
        hits.select(
            "institution_id",
            F.lit("esfa").alias("notice_body"),
            F.col("c.notice_type").alias("notice_type"),
            F.lit(None).cast("string").alias("issued_at"),
            F.col("c.withdrawn_at").alias("withdrawn_at"),
            F.col("c.severity").alias("severity"),
            F.col("title").alias("subject"),
            F.concat(F.lit("Section on collection: "), F.col("section")).alias("details"),
            F.col("href").alias("source_url"),
            "row_no",
        )
    )


def merge_list_notices(notices: DataFrame, found: DataFrame) -> DataFrame:
    return upsert(
        notices, found, NOTICE_KEY, overwrite=["withdrawn_at", "severity", "subject", "details"], order="row_no"
    )


def merge_company_notices(notices: DataFrame, found: DataFrame) -> DataFrame:
    return upsert(notices, found, NOTICE_KEY, overwrite=["subject", "details"])


def split_active(notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    active = F.col("withdrawn_at").isNull()
    return notices.where(active), notices.where(~active)

"""Key lookups and evidence flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import latest_per, top_n_per

MIN_NEWS_SIGNAL = 50


def spread_null(key: Column, row_id: Column) -> Column:
    """A null join key replaced by a per-row value that matches nothing.

    A left join would send all null keys to one task.
    """
    return F.coalesce(key, F.concat(F.lit("\x00"), row_id.cast("string")))


def resolve_by_keys(df: DataFrame, dimension: DataFrame, keys: Sequence[str], row_id: str, out: str = "institution_id") -> DataFrame:
    """Id of the first alternate key that is known (for example urn, else ukprn)."""
    found: list[Column] = []
    for i, key in enumerate(keys):
        side = (
            dimension.where(F.col(key).isNotNull())
            .groupBy(F.col(key).alias(f"__k{i}"))
            .agg(F.min("id").alias(f"__id{i}"))
        )
        df = df.join(side, spread_null(F.col(key), F.col(row_id)) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(F.col(f"__id{i}"))
    return df.withColumn(out, F.coalesce(*found)).drop(*[f"__id{i}" for i in range(len(keys))])


def lookup(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in the dimension, with its id."""
    side = dimension.where(F.col(key).isNotNull()).select(key, F.col("id").alias("institution_id"))
    return df.join(side, key, "inner")


def evidence_flags(inspections: DataFrame, notices: DataFrame, news: DataFrame, min_severity: int = MIN_NEWS_SIGNAL) -> DataFrame:
    """One row per institution with any evidence, one flag per kind.

    The three facts are reduced to a bit set per institution before they
    travel: one exchange of small rows replaces three EXISTS probes, and an
    institution that owns a third of a fact ships one row per task.
    """

    def bits(df: DataFrame, **flags: Column) -> DataFrame:
        names = ["inspection", "report_url", "report_text", "notice", "news"]
        return df.select(
            "institution_id", *[(flags[n] if n in flags else F.lit(False)).alias(n) for n in names]
        )

    text = F.col("report_text").isNotNull() if "report_text" in inspections.columns else F.lit(False)
    rows = (
        bits(inspections, inspection=F.lit(True), report_url=F.col("report_url").isNotNull(), report_text=text)
        .unionByName(bits(notices.where(F.col("withdrawn_at").isNull()), notice=F.lit(True)))
        .unionByName(bits(news.where(F.col("trigger_severity") >= min_severity), news=F.lit(True)))
    )
    return rows.groupBy("institution_id").agg(
        F.max("inspection").alias("any_inspection"),
        F.max("report_url").alias("with_report_url"),
        F.max("report_text").alias("with_report_text"),
        F.max("notice").alias("with_active_compliance"),
        F.max("news").alias("with_news_signal"),
    )


FLAGS = ["any_inspection", "with_report_url", "with_report_text", "with_active_compliance", "with_news_signal"]


def with_evidence(institutions: DataFrame, inspections: DataFrame, notices: DataFrame, news: DataFrame) -> DataFrame:
    """Institutions with the five evidence flags and ``actionable``."""
    flags = evidence_flags(inspections, notices, news).withColumnRenamed("institution_id", "id")
    out = institutions.join(flags, "id", "left")
    out = out.withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in FLAGS})
    return out.withColumn(
        "actionable", F.col("with_report_url") | F.col("with_active_compliance") | F.col("with_news_signal")
    )


def actionable(institutions: DataFrame, inspections: DataFrame, notices: DataFrame, news: DataFrame, min_standards: int | None = None) -> DataFrame:
    """Institutions with something to click through to.

    ``min_standards`` adds the university rule: enough standards also counts.
    """
    df = with_evidence(institutions, inspections, notices, news)
    keep = F.col("actionable")
    if min_standards is not None:
        keep = keep | F.coalesce(F.col("apprenticeship_standards") >= min_standards, F.lit(False))
    return df.where(keep).select(*institutions.columns)


def without_evidence(institutions: DataFrame, inspections: DataFrame, notices: DataFrame, news: DataFrame) -> DataFrame:
    """Institutions with no report link, active notice or news signal."""
    df = with_evidence(institutions, inspections, notices, news)
    return df.where(~F.col("actionable")).select(*institutions.columns)


LATEST_COLUMNS = {
    "latest_inspection_id": "id",
    "latest_grade": "overall_grade",
    "latest_inspection_date": "inspection_start_date",
    "latest_report_url": "report_url",
}


def with_latest(institutions: DataFrame, inspections: DataFrame, how: str = "left") -> DataFrame:
    """Institutions with the columns of their latest inspection."""
    need = sorted(set(LATEST_COLUMNS.values()) | {"institution_id"})
    latest = latest_per(inspections.select(*need), "institution_id", "inspection_start_date").select(
        F.col("institution_id").alias("id"), *[F.col(c).alias(a) for a, c in LATEST_COLUMNS.items()]
    )
    return institutions.join(latest, "id", how)


def top_by(df: DataFrame, key: str, measure: str, id_: str = "id") -> DataFrame:
    """The row with the greatest measure per key; of several the last by id."""
    return top_n_per(df, [key], [F.col(measure).desc(), F.col(id_).desc()], 1)


def with_reference_inspection(institutions: DataFrame, scores: DataFrame, inspections: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scores and the scored inspection, else the latest one, joined in.

    The latest inspection is precomputed: a correlated subquery cannot stand
    in a join condition.
    """
    latest = latest_per(
        inspections.select("id", "institution_id", "inspection_start_date"), "institution_id", "inspection_start_date"
    ).select(F.col("institution_id").alias("id"), F.col("id").alias("__latest"))
    scored = scores.withColumnRenamed("institution_id", "id")
    ref = institutions.join(scored, "id", "left").join(latest, "id", "left")
    ref = ref.withColumn("__ref", F.coalesce("last_inspection_id", "__latest")).drop("__latest")
    detail = inspections.select(F.col("id").alias("__ref"), *columns)
    return ref.join(detail, "__ref", "left").withColumnRenamed("__ref", "reference_inspection_id")


def with_counts(parents: DataFrame, children: DataFrame, child_key: str, out: str) -> DataFrame:
    """Left join to the pre-counted child (null where there is none)."""
    counted = children.groupBy(F.col(child_key).alias("id")).agg(F.count(F.lit(1)).alias(out))
    return parents.join(counted, "id", "left")


def with_top_finding(scores: DataFrame, findings: DataFrame, how: str = "left") -> DataFrame:
    side = findings.select(
        F.col("id").alias("top_finding_id"),
        F.col("phrase_id").alias("top_phrase_id"),
        F.col("section_key").alias("top_section_key"),
        F.col("source_quote").alias("top_quote"),
    )
    return scores.join(side, "top_finding_id", how)

"""Per-institution evidence: one small row each, aggregated before any join.

All bags come out hash-partitioned by institution_id, so joining them to one
another needs no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import SIX_GRADE_RANK
from ..functions.text import lookup, strip
from ..schemas import CURRICULA
from .ranking import top_n_per

# ---- fixed values: section focus of findings -------------------------------
SECTION_FOCUS = {
    "safeguarding": 1.6,
    "personal_development": 1.5,
    "behaviour_attitudes": 1.3,
    "what_school_needs_to_improve": 1.0,
    "what_provider_needs_to_improve": 1.0,
    "areas_for_action": 1.0,
    "recommendations": 1.0,
    "areas_for_improvement": 1.0,
    "main_findings": 0.7,
    "summary": 0.3,
    "significant_strengths": 0.0,
    "strengths": 0.0,
}
OTHER_FOCUS = 0.5
UNKNOWN_GRADE_RANK = 99
#: Signals of one kind that the scoring rules read.
SIGNALS_SCORED = 3
MIN_NEWS_SEVERITY = 70
MIN_NEWS_RELEVANCE = 60
# ---------------------------------------------------------------------------


def section_focus(key: Column) -> Column:
    return F.coalesce(lookup(key, SECTION_FOCUS), F.lit(OTHER_FOCUS))


def inspection_meta(inspections: DataFrame, latest: Sequence[str] = ()) -> DataFrame:
    """Count, first and last date, best grade ever; optionally the latest row.

    ``latest`` names columns of the newest inspection to carry along as the
    struct ``latest`` (equal dates: lowest id). Everything is one aggregate.
    """
    grade = F.col("overall_grade")
    rank = F.struct(F.coalesce(lookup(grade, SIX_GRADE_RANK), F.lit(UNKNOWN_GRADE_RANK)), F.col("id"))
    aggs = [
        F.count(F.lit(1)).alias("inspection_count"),
        F.min("inspection_start_date").alias("first_inspection_date"),
        F.max("inspection_start_date").alias("latest_inspection_date"),
        F.min_by(grade, F.when(grade != "", rank)).alias("best_grade"),
    ]
    if latest:
        newest = F.struct(F.col("inspection_start_date"), -F.col("id"))
        aggs.append(F.max_by(F.struct(*latest), newest).alias("latest"))
    return inspections.groupBy("institution_id").agg(*aggs)


def finding_bag(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """Weighted totals per curriculum, distinct findings, strongest finding.

    The bridge is folded to one row per finding first (both inputs spread
    evenly over finding ids); the institution aggregate then combines on the
    map side, so a verbose institution ships one partial row per task.
    """
    per_finding = matches.groupBy(F.col("finding_id").alias("id")).agg(
        *[F.count_if(F.col("curriculum") == c).alias(f"n_{c}") for c in CURRICULA]
    )
    joined = (
        findings.where(~F.col("suppressed"))
        .select("id", "institution_id", (F.col("final_severity") * section_focus(F.col("section_key"))).alias("weight"))
        .withColumn("exact", F.col("weight").cast("decimal(18, 4)"))
        .join(per_finding, "id")
    )
    strongest = F.when(F.col("weight") > 0, F.struct(F.col("weight"), -F.col("id")))
    return joined.groupBy("institution_id").agg(
        # Weights have at most three decimals: sums of decimals do not depend on the order of the rows.
        *[F.sum(F.col("exact") * F.col(f"n_{c}")).cast("double").alias(f"{c}_total") for c in CURRICULA],
        F.count(F.lit(1)).alias("finding_count"),
        F.max_by("id", strongest).alias("top_finding_id"),
    )


def _strongest_first(df: DataFrame, severity: str, fields: Sequence[str], out: str, kept: int) -> DataFrame:
    """The ``kept`` strongest rows per institution as an array: the score reads no more of them."""
    top = top_n_per(df, ["institution_id"], [F.col(severity).desc(), F.col("id").asc()], kept, rank_as="rn")
    packed = F.struct("rn", F.col(severity).alias("severity"), *fields)
    return top.groupBy("institution_id").agg(F.sort_array(F.collect_list(packed)).alias(out))


def notice_bag(notices: DataFrame, kept: int = SIGNALS_SCORED) -> DataFrame:
    """Active notices: the ``kept`` most severe, the worst severity, the number."""
    active = notices.where(F.col("withdrawn_at").isNull())
    top = _strongest_first(
        active.select("institution_id", "id", "severity", "subject", "source_url"), "severity", ["subject", "source_url"], "top_notices", kept
    )
    counted = active.groupBy("institution_id").agg(
        F.count(F.lit(1)).alias("notice_count"), F.max("severity").alias("worst_severity")
    )
    return top.join(counted, "institution_id")


def news_bag(news: DataFrame, kept: int = SIGNALS_SCORED) -> DataFrame:
    """News that counts (severity or relevance high enough): the ``kept`` strongest."""
    counted = news.where(
        (F.col("trigger_severity") >= MIN_NEWS_SEVERITY) | (F.col("relevance") >= MIN_NEWS_RELEVANCE)
    )
    tags = F.filter(
        F.transform(F.split(F.coalesce("curricula_tagged", F.lit("")), ","), strip), lambda t: t != ""
    )
    rows = counted.select(
        "institution_id", "id", "trigger_severity", "title", "angle", "published_at", tags.alias("curricula")
    )
    return _strongest_first(rows, "trigger_severity", ["title", "angle", "published_at", "curricula"], "top_news", kept)

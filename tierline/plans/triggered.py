"""Trigger lists and name search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grams import GramIndex
from ..operators.joins import with_latest
from .profiles import WEAK_GRADES
from .tables import Tables


def shown(column: str, width: int | None) -> Column:
    return F.col(column) if width is None else F.substring(column, 1, width).alias(column)


def weak_without_text(t: Tables, n: int | None = None, type_: str = "itp") -> DataFrame:
    """Weak inspections of a type whose report text is still missing, newest first."""
    weak = t.inspections.where(
        F.col("overall_grade").isin(*WEAK_GRADES) & F.col("report_text").isNull() & F.col("report_url").isNotNull()
    ).select("id", "institution_id", "overall_grade", "inspection_start_date", "report_url")
    inst = t.institutions.where(F.col("type") == type_).select(F.col("id").alias("institution_id"), "name")
    order = [F.col("inspection_start_date").desc(), F.col("id").asc()]
    df = weak.join(inst, "institution_id").orderBy(*order)
    return df if n is None else df.limit(n)


def recent_weak_count(t: Tables, since: str, type_: str = "itp") -> DataFrame:
    """Institutions whose latest inspection is weak and was published since."""
    scope = t.institutions.where((F.col("type") == type_) & F.col("in_scope")).select("id")
    latest = with_latest(scope, t.inspections, "inner")
    published = t.inspections.select(F.col("id").alias("latest_inspection_id"), "publication_date")
    hit = F.col("latest_grade").isin(*WEAK_GRADES) & (F.col("publication_date") >= since)
    return latest.join(published, "latest_inspection_id").where(hit).agg(F.count(F.lit(1)).alias("recent_weak"))


def high_trigger_news(
    t: Tables, min_severity: int = 70, min_relevance: int = 50, title: int | None = None, angle: int | None = None
) -> DataFrame:
    """All strong, relevant news with the institution, strongest first.

    ``title`` and ``angle`` are widths to show them in (None: whole).
    """
    strong = t.news.where((F.col("trigger_severity") >= min_severity) & (F.col("relevance") >= min_relevance))
    inst = t.institutions.select(F.col("id").alias("institution_id"), "name", "type")
    return (
        strong.select(
            "id", "institution_id", "trigger_severity", "relevance", "source", "published_at",
            shown("title", title), shown("angle", angle),
        )
        .join(inst, "institution_id")
        .orderBy(F.col("trigger_severity").desc(), F.col("id").asc())
    )


def triggered(t: Tables, n: int, type_: str = "itp") -> DataFrame:
    """The most urgent institutions with their notice and news counts.

    Children are counted for the ranked rows only.
    """
    df = t.scored().where((F.col("type") == type_) & F.col("in_scope"))
    order = [F.col("urgency_score").desc(), F.col("score").desc(), F.col("id").asc()]
    best = df.orderBy(*order).limit(n).select(
        "id", "name", "type", "tier", "score", "urgency_score", "pipeline_value_score", "top_curriculum"
    )
    ids = best.select(F.col("id").alias("institution_id"))

    def counted(child: DataFrame, out: str) -> DataFrame:
        mine = child.join(ids, "institution_id", "left_semi")
        return mine.groupBy(F.col("institution_id").alias("id")).agg(F.count(F.lit(1)).alias(out))

    notices = counted(t.notices.where(F.col("withdrawn_at").isNull()), "compliance_count")
    news = counted(t.news.where(F.col("trigger_severity") >= 50), "news_count")
    joined = best.join(notices, "id", "left").join(news, "id", "left")
    return joined.fillna(0, ["compliance_count", "news_count"]).orderBy(*order)


def notice_impact(t: Tables, n: int | None = None, type_: str = "itp") -> DataFrame:
    """(institution, active notice) rows of a type, most urgent first."""
    active = t.notices.where(F.col("withdrawn_at").isNull()).select(
        F.col("id").alias("notice_id"), F.col("institution_id").alias("id")
    )
    df = t.scored().where(F.col("type") == type_).select(
        "id", "name", "tier", "score", "urgency_score", "pipeline_value_score"
    )
    order = [F.col("urgency_score").desc(), F.col("id").asc(), F.col("notice_id").asc()]
    df = df.join(active, "id").orderBy(*order)
    return df if n is None else df.limit(n)


def finding_coverage(t: Tables, type_: str = "itp") -> DataFrame:
    """Institutions of a type with findings, and findings in total."""
    per = t.findings.groupBy(F.col("institution_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    df = per.join(t.institutions.where(F.col("type") == type_).select("id"), "id")
    return df.agg(
        F.count(F.lit(1)).alias("institutions_with_findings"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_findings")
    )


SEARCH_COLUMNS = ["id", "name", "type", "ukprn", "urn", "apprenticeship_standards", "in_scope", "source"]


def _biggest_first(found: DataFrame) -> DataFrame:
    return found.select(*SEARCH_COLUMNS).orderBy(F.col("apprenticeship_standards").desc_nulls_last(), F.col("id").asc())


def name_search(institutions: DataFrame, patterns: list[str]) -> DataFrame:
    """Institutions whose name is like any of the patterns, biggest first."""
    any_of = reduce(lambda a, b: a | b, [F.col("name").ilike(p) for p in patterns])
    return _biggest_first(institutions.where(any_of))


def store_name_index(institutions: DataFrame, path: str) -> GramIndex:
    return GramIndex.build(institutions.select(*SEARCH_COLUMNS), "id", "name", path)


def name_search_stored(index: GramIndex, patterns: list[str]) -> DataFrame:
    """:func:`name_search` through a stored index of names."""
    return _biggest_first(index.search(patterns))

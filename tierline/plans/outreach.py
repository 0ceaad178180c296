"""Outreach rows and email context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import grade_label
from ..functions.names import phrase_label, split_name
from ..functions.text import non_blank
from ..operators.joins import with_top_finding
from ..operators.ranking import latest_per, top_n_per
from .tables import Tables

DEFAULT_CURRICULUM = "confidence_resilience"
MIN_TOP_NEWS = 60


def outreach_rows(t: Tables, value_width: int | None = None) -> DataFrame:
    """One contact row per institution with a mailbox: names and merge variables (cut to ``value_width``, if given)."""
    email = F.coalesce(non_blank(F.col("head_email")), non_blank(F.col("general_email")))
    inst = t.institutions.withColumn("email", email).where(F.col("email").isNotNull())
    inst = inst.select("id", "name", "region", "type", "head_name", "email")
    scores = t.scores.select(F.col("institution_id").alias("id"), "score", "top_curriculum", "top_finding_id")
    insp = t.inspections.select(
        "id", "institution_id", "inspection_start_date", "overall_grade", "previous_overall_grade", "report_url"
    )
    latest = latest_per(insp, "institution_id", "inspection_start_date").select(
        F.col("institution_id").alias("id"), "inspection_start_date", "overall_grade", "previous_overall_grade", "report_url"
    )
    df = with_top_finding(inst.join(scores, "id", "left").join(latest, "id", "left"), t.findings)
    variables: dict[str, Column] = {
        "top_curriculum": F.col("top_curriculum"),
        "top_weakness": F.col("top_phrase_id"),
        "top_weakness_quote": F.col("top_quote"),
        "latest_grade": grade_label(F.col("overall_grade")),
        "previous_grade": grade_label(F.col("previous_overall_grade")),
        "inspection_date": F.col("inspection_start_date"),
        "inspection_url": F.col("report_url"),
        "opportunity_score": F.col("score").cast("string"),
        "region": F.col("region"),
        "institution_type": F.col("type"),
    }
    cut = (lambda c: c) if value_width is None else (lambda c: F.substring(c, 1, value_width))
    pairs = [p for name, col in variables.items() for p in (F.lit(name), cut(col))]
    kept = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != ""))
    person = split_name(F.col("head_name"))
    return df.select(
        "id",
        "email",
        F.col("name").alias("company_name"),
        person["first"].alias("first_name"),
        person["last"].alias("last_name"),
        kept.alias("custom_variables"),
    )


def email_context(t: Tables) -> DataFrame:
    """Merge fields of the email plus the top notice and top article."""
    inst = t.institutions.select("id", "name", "region", "head_name")
    scores = t.scores.select(F.col("institution_id").alias("id"), "top_curriculum")
    insp = t.inspections.select("id", "institution_id", "inspection_start_date", "overall_grade", "previous_overall_grade", "report_url")
    latest = latest_per(insp, "institution_id", "inspection_start_date").select(
        F.col("institution_id").alias("id"), "inspection_start_date", "overall_grade", "previous_overall_grade", "report_url"
    )
    finding = top_n_per(
        t.findings.where(~F.col("suppressed")), ["institution_id"], [F.col("final_severity").desc(), F.col("id").asc()], 1
    ).select(F.col("institution_id").alias("id"), "phrase_id", "section_key", "source_quote")
    notice = top_n_per(
        t.notices.where(F.col("withdrawn_at").isNull()), ["institution_id"], [F.col("severity").desc(), F.col("id").asc()], 1
    ).select(F.col("institution_id").alias("id"), F.col("subject").alias("notice_subject"), F.col("severity").alias("notice_severity"))
    strong = (F.col("relevance") >= MIN_TOP_NEWS) & (F.col("trigger_severity") >= MIN_TOP_NEWS)
    article = top_n_per(
        t.news.where(strong),
        ["institution_id"],
        [F.col("trigger_severity").desc(), F.col("published_at").desc_nulls_last(), F.col("id").asc()],
        1,
    ).select(F.col("institution_id").alias("id"), F.col("title").alias("news_title"), F.col("trigger_severity").alias("news_severity"))
    df = inst.join(scores, "id")
    for side in (latest, finding, notice, article):
        df = df.join(side, "id", "left")
    return df.select(
        "id",
        F.coalesce("top_curriculum", F.lit(DEFAULT_CURRICULUM)).alias("top_curriculum"),
        F.col("name").alias("institution_name"),
        "region",
        F.date_format(F.col("inspection_start_date").try_cast("date"), "d MMM yyyy").alias("inspection_date"),
        F.col("overall_grade").alias("current_grade"),
        F.col("previous_overall_grade").alias("previous_grade"),
        phrase_label(F.col("phrase_id")).alias("top_weakness"),
        "source_quote",
        F.col("section_key").alias("source_section"),
        "report_url",
        "head_name",
        "notice_subject",
        "notice_severity",
        "news_title",
        "news_severity",
    )



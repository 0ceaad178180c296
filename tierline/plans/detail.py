"""Everything on file about institutions, in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import phrase_label
from ..functions.text import strip
from ..operators.ranking import latest_with_children, top_n_per
from .tables import Tables

# ---- fixed values ---------------------------------------------------------
PHRASE_FAMILIES = {
    "fin_lit": "financial_literacy",
    "emp": "employability_skills",
    "cr": "confidence_resilience",
    "os": "online_safety",
    "shared": "confidence_resilience",
}
QUOTED_SECTIONS = {
    "what_provider_needs_to_improve": "What this provider needs to improve",
    "what_school_needs_to_improve": "What this school needs to improve",
    "areas_for_action": "Areas for action",
    "areas_for_improvement": "Areas for improvement",
    "recommendations": "Recommendations",
    "apprenticeships": "Apprenticeships",
    "adult_learning": "Adult learning programmes",
    "young_peoples_provision": "Education programmes for young people",
    "high_needs_provision": "Provision for learners with high needs",
    "quality_of_education": "Quality of education",
    "behaviour_attitudes": "Behaviour and attitudes",
    "personal_development": "Personal development",
    "leadership_management": "Leadership and management",
    "safeguarding": "Safeguarding",
    "main_findings": "What is it like to be a learner here / What does the provider do well",
}
MIN_QUOTE = 30
# ---------------------------------------------------------------------------


def section_quotes(sections: DataFrame, main_findings_cap: int | None = None, cap: int | None = None) -> DataFrame:
    """First section per key of an inspection, blanks trimmed.

    A ``cap`` cuts longer quotes with an ellipsis; main findings have their own.
    """
    first = top_n_per(
        sections.where(F.col("section_key").isin(*QUOTED_SECTIONS)),
        ["inspection_id", "section_key"],
        [F.col("order_index").asc()],
        1,
    )
    text = strip(F.col("section_text"))
    most = F.when(F.col("section_key") == "main_findings", F.lit(main_findings_cap)).otherwise(F.lit(cap))
    cut = F.when(F.length(text) > most, F.concat(text.substr(F.lit(1), most), F.lit("…"))).otherwise(text)
    return first.where(F.length(text) >= MIN_QUOTE).select(
        "inspection_id", "section_key", "order_index", cut.alias("quote")
    )


def phrase_family(phrase_id: Column) -> Column:
    prefix = F.substring_index(phrase_id, ".", 1)
    out = None
    for key, curriculum in PHRASE_FAMILIES.items():
        out = F.when(prefix == key, curriculum) if out is None else out.when(prefix == key, curriculum)
    return out.otherwise("other")


def group_findings(findings: DataFrame) -> DataFrame:
    """Findings with their curriculum group and its size.

    Rows stay rows (a group is never gathered): order by group_size desc,
    curriculum, final_severity desc, id to read the groups.
    """
    rows = findings.where(~F.col("suppressed")).withColumns(
        {"curriculum": phrase_family(F.col("phrase_id")), "label": phrase_label(F.col("phrase_id"))}
    )
    sizes = rows.groupBy("institution_id", "curriculum").agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, ["institution_id", "curriculum"]).select(
        "institution_id", "curriculum", "group_size", "id", "phrase_id", "label", "section_key", "source_quote",
        "final_severity",
    )


def detail_records(t: Tables, ids: DataFrame | None = None, quote_cap: int | None = None) -> DataFrame:
    """institution_id, kind, rank columns and a struct-as-JSON payload.

    One row per inspection, finding, notice, news item and quoted section. The
    long form holds an institution of any size: readers order by
    (institution_id, kind, rank_number desc, rank_text desc, item_id).
    """

    def block(df: DataFrame, kind: str, number: Column, text: Column, fields: list[str]) -> DataFrame:
        if ids is not None:
            df = df.join(ids.select(F.col("id").alias("institution_id")), "institution_id", "left_semi")
        return df.select(
            "institution_id",
            F.lit(kind).alias("kind"),
            number.cast("double").alias("rank_number"),
            text.alias("rank_text"),
            F.col("id").alias("item_id"),
            F.to_json(F.struct(*fields)).alias("payload"),
        )

    none = F.lit(None).cast("string")
    latest = latest_with_children(
        t.inspections.select("id", "institution_id", "inspection_start_date"),
        t.sections, "institution_id", "inspection_start_date", "inspection_id",
    ).select(F.col("id").alias("inspection_id"), "institution_id")
    quotes = section_quotes(t.sections, quote_cap, quote_cap).join(latest, "inspection_id").withColumn("id", F.col("inspection_id"))
    return (
        block(
            t.inspections, "inspection", F.lit(None), F.col("inspection_start_date"),
            ["inspection_body", "overall_grade", "previous_overall_grade", "grade_dropped", "report_url"],
        )
        .unionByName(
            block(t.findings, "finding", F.col("final_severity"), none, ["phrase_id", "section_key", "source_quote", "suppressed"])
        )
        .unionByName(
            block(t.notices, "notice", F.col("severity"), F.col("issued_at"), ["notice_body", "notice_type", "subject", "withdrawn_at", "source_url"])
        )
        .unionByName(
            block(t.news, "news", F.col("trigger_severity"), F.col("published_at"), ["title", "url", "relevance", "angle"])
        )
        .unionByName(block(quotes, "section", -F.col("order_index"), none, ["section_key", "quote"]))
    )

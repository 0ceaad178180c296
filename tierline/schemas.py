"""Table schemas and enumerations.

Dates are ISO text (they compare lexicographically, and impossible calendar
days must survive cleaning); scores are integers; lists are arrays in memory
and joined text only in sinks.
"""

from __future__ import annotations

# ---- enumerations ---------------------------------------------------------
INSTITUTION_TYPES = [
    "state_school", "independent_school", "sixth_form_college", "fe_college",
    "itp", "university", "employer", "other",
]
GRADES = [
    "outstanding", "good", "requires_improvement", "inadequate",
    "meets_standard", "does_not_meet_standard", "not_judged",
]
CURRICULA = ["financial_literacy", "employability_skills", "confidence_resilience", "online_safety"]
TIERS = ["critical", "high", "worth_a_look", "skip"]
TEXT_JUDGEMENTS = [
    "quality_of_education", "behaviour_attitudes", "personal_development", "leadership_management",
    "sixth_form_provision", "apprenticeships", "adult_learning_programmes",
    "inclusion", "attendance_behaviour", "personal_dev_wellbeing", "achievement", "curriculum_teaching",
    "young_peoples_provision", "high_needs_provision", "contribution_to_skills",
]
# ---------------------------------------------------------------------------


def _ddl(text: str) -> str:
    """DDL string, accepted wherever Spark takes a schema."""
    return " ".join(text.split())


INSTITUTIONS = _ddl(
    """id bigint, urn string, ukprn string, isi_id string, name string, type string, phase string,
    region string, local_authority string, postcode string, address string, gender string,
    religious_character string, website string, phone string, general_email string, head_name string,
    head_email string, in_scope boolean, out_of_scope_reason string, source string,
    apprenticeship_standards int, updated_at timestamp"""
)
INSPECTIONS = _ddl(
    """id bigint, institution_id bigint, inspection_body string, framework string, inspection_type string,
    inspection_start_date string, publication_date string, report_url string, report_text string,
    overall_grade string, """
    + ", ".join(f"{c} string" for c in TEXT_JUDGEMENTS)
    + ", safeguarding_effective boolean, previous_overall_grade string, grade_dropped boolean"
)
REPORT_SECTIONS = _ddl(
    """inspection_id bigint, section_key string, section_title string, section_text string,
    multiplier double, order_index int"""
)
FINDINGS = _ddl(
    """id decimal(38,0), inspection_id bigint, institution_id bigint, phrase_id string, phrase_pattern string,
    section_key string, source_quote string, quote_start int, quote_end int, base_severity int,
    multiplier double, final_severity double, suppressed boolean, suppression_reason string"""
)
CURRICULUM_MATCHES = _ddl("finding_id decimal(38,0), institution_id bigint, curriculum string, weight double")
COMPLIANCE_NOTICES = _ddl(
    """id bigint, institution_id bigint, notice_body string, notice_type string, issued_at string,
    withdrawn_at string, severity int, subject string, details string, source_url string"""
)
NEWS_ITEMS = _ddl(
    """id bigint, institution_id bigint, source string, url string, title string, excerpt string,
    published_at string, relevance int, trigger_severity int, curricula_tagged string, angle string,
    content_hash string"""
)
OPPORTUNITY_SCORES = _ddl(
    """institution_id bigint, score int, urgency_score int, pipeline_value_score int, raw_score int,
    financial_literacy_score int, employability_skills_score int, confidence_resilience_score int,
    online_safety_score int, top_curriculum string, top_curriculum_score int, top_finding_id decimal(38,0),
    critical_signals array<string>, tier string, finding_count bigint, inspection_count bigint,
    first_inspection_date string, latest_inspection_date string, last_inspection_id bigint"""
)
INGESTION_RUNS = _ddl(
    """id bigint, source string, started_at timestamp, completed_at timestamp, status string,
    records_seen bigint, records_upserted bigint, error_message string"""
)
PHRASES = _ddl(
    """id string, pattern string, regex boolean, severity int, curricula array<string>,
    guards array<string>, source_file string"""
)
COMPANY_PROFILE = _ddl(
    """company_number string, company_name string, company_status string, company_status_detail string,
    date_of_creation string, date_of_cessation string,
    accounts struct<next_due: string, last_accounts: struct<period_end_on: string>, overdue: boolean>,
    confirmation_statement struct<next_due: string, overdue: boolean>"""
)
INSOLVENCY = _ddl("cases array<struct<type: string, dates: array<struct<type: string, date: string>>>>")

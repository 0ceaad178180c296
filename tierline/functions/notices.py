"""Regulatory notices: classification, severity, candidate names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lookup, non_blank, present, strip, word

# ---- fixed values ---------------------------------------------------------
NOTICE_SEVERITY = {
    "apar.not_currently_starting_new_apprentices": 85,
    "apar.removed": 95,
    "apar.suspended": 92,
    "apar.conditions_imposed": 80,
    "apar.status_other": 60,
    "esfa.notice_to_improve_quality": 95,
    "esfa.notice_to_improve_financial": 88,
    "esfa.notice_to_improve_governance": 88,
    "esfa.notice_to_improve_other": 80,
    "dfe.financial_intervention": 90,
    "dfe.minimum_standards_intervention": 92,
    "dfe.intervention_other": 75,
    "govuk.intervention_announced": 75,
    "govuk.notice_issued": 80,
    "govuk.compliance_action": 78,
    "companies_house.accounts_overdue": 70,
    "companies_house.confirmation_overdue": 60,
    "companies_house.insolvency": 95,
    "companies_house.dissolution": 95,
    "companies_house.strike_off": 92,
    "companies_house.gazette_notice": 65,
    "companies_house.administration": 90,
    "companies_house.liquidation": 92,
}
COMPANY_SEVERITY = {
    "companies_house.insolvency": 95,
    "companies_house.dissolution": 95,
    "companies_house.liquidation": 92,
    "companies_house.administration": 92,
    "companies_house.accounts_overdue": 70,
    "companies_house.confirmation_overdue": 60,
}
DEFAULT_SEVERITY = 50
CLOSED_SEVERITY = 30
# (text in the status, notice type, subject), first hit decides
REGISTER_STATUS_RULES = [
    (
        "not currently starting new apprentices",
        "apar.not_currently_starting_new_apprentices",
        "APAR status: Not currently starting new apprentices (regulatory restriction)",
    ),
    ("removed", "apar.removed", "APAR status: Removed from register"),
    ("suspended", "apar.suspended", "APAR status: Suspended"),
    ("conditions", "apar.conditions_imposed", "APAR status: Conditions imposed"),
]
COMPLIANCE_KEYWORDS = [
    word(r"notice to improve"),
    word(r"financial notice"),
    word(r"quality notice"),
    word(r"governance notice"),
    word(r"intervention"),
    word(r"removed from\s+(?:the\s+)?(?:register|apar|roatp)"),
    word(r"suspended from\s+(?:apar|roatp)"),
    word(r"subcontracting standard"),
    word(r"minimum standards"),
    word(r"(?:fe\s+)?commissioner"),
    word(r"safeguarding (?:concern|failure|investigation)"),
    word(r"fraud (?:investigation|charges?)"),
]
NOTICE_WORDS = r"(?i)notice to improve|financial notice|quality notice|governance notice"
INTERVENTION_WORDS = r"(?i)intervention|commissioner"
TITLE_KIND_WORDS = r"(?i)notice to improve|financial|quality|governance"
NAMED_AFTER = r"(?i)(?:report on|notice (?:issued )?to)\s+(.+?)(?:\.|\z)"
# ---------------------------------------------------------------------------


def severity_for(notice_type: Column, table: dict[str, int] = NOTICE_SEVERITY) -> Column:
    return F.coalesce(lookup(notice_type, table), F.lit(DEFAULT_SEVERITY))


def classify_register_status(status: Column) -> Column:
    """struct(notice_type, subject), or null for a blank status."""
    s = strip(status)
    low = F.lower(s)

    def pair(kind: str, subject: Column) -> Column:
        return F.struct(F.lit(kind).alias("notice_type"), subject.alias("subject"))

    out = F.when(s.isNull() | (s == ""), None)
    for needle, kind, subject in REGISTER_STATUS_RULES:
        out = out.when(low.contains(needle), pair(kind, F.lit(subject)))
    return out.otherwise(pair("apar.status_other", F.concat(F.lit("APAR status: "), s)))


def classify_feed_entry(title: Column, summary: Column) -> Column:
    """struct(notice_type, matched) when a compliance keyword occurs, else null."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(summary, F.lit("")))
    matched = F.coalesce(*[non_blank(F.regexp_extract(text, f"(?i){k}", 0)) for k in COMPLIANCE_KEYWORDS])
    kind = (
        F.when(text.rlike(NOTICE_WORDS), "govuk.notice_issued")
        .when(text.rlike(INTERVENTION_WORDS), "govuk.intervention_announced")
        .otherwise("govuk.compliance_action")
    )
    return F.when(matched.isNotNull(), F.struct(kind.alias("notice_type"), matched.alias("matched")))


def name_candidates(title: Column) -> Column:
    """Plausible organisation names in a feed title (array, no repeats)."""
    parts = F.transform(F.split(title, ":"), strip)
    named = strip(F.regexp_extract(title, NAMED_AFTER, 1))
    kept = F.filter(parts, lambda p: (F.length(p) >= 6) & p.rlike("[A-Z]"))
    return F.array_distinct(F.concat(kept, F.filter(F.array(named), lambda n: n != "")))


def notice_title_type(title: Column) -> Column:
    return (
        F.when(title.rlike("(?i)financial"), "esfa.notice_to_improve_financial")
        .when(title.rlike("(?i)quality"), "esfa.notice_to_improve_quality")
        .when(title.rlike("(?i)governance"), "esfa.notice_to_improve_governance")
        .otherwise("esfa.notice_to_improve_other")
    )


def classify_notice_title(title: Column, section: Column, as_of: str) -> Column:
    """struct(college, notice_type, closed, severity, withdrawn_at)."""
    parts = F.transform(F.split(title, ":"), strip)
    side = F.get(F.filter(parts, lambda p: ~p.rlike(TITLE_KIND_WORDS)), F.lit(0))
    college = F.when(title.contains(":") & present(side), side).otherwise(title)
    closed = title.rlike(r"(?i)^(?:closed|revoked)(?![0-9A-Za-z_])") | F.coalesce(
        section.rlike("(?i)closed"), F.lit(False)
    )
    kind = notice_title_type(title)
    return F.struct(
        college.alias("college"),
        kind.alias("notice_type"),
        closed.alias("closed"),
        F.when(closed, CLOSED_SEVERITY).otherwise(severity_for(kind)).alias("severity"),
        F.when(closed, as_of).alias("withdrawn_at"),
    )


def company_notices(profile: Column, insolvency_cases: Column) -> Column:
    """array<struct(notice_type, subject)> for one company profile.

    ``profile`` is the struct of :data:`tierline.schemas.COMPANY_PROFILE`,
    ``insolvency_cases`` the number of cases on file (null when none).
    """
    status = F.lower(F.coalesce(profile["company_status"], F.lit("")))
    reason = F.coalesce(non_blank(profile["company_status_detail"]), status)

    def notice(kind: str, subject: Column) -> Column:
        return F.struct(F.lit(f"companies_house.{kind}").alias("notice_type"), subject.alias("subject"))

    prefix = "Companies House: "
    state = (
        F.when(
            status == "dissolved",
            notice(
                "dissolution",
                F.concat(
                    F.lit(prefix + "dissolved"),
                    F.coalesce(F.concat(F.lit(" "), non_blank(profile["date_of_cessation"])), F.lit("")),
                ),
            ),
        )
        .when(
            status.contains("liquidation"),
            notice("liquidation", F.concat(F.lit(prefix + "in liquidation ("), reason, F.lit(")"))),
        )
        .when(
            status.contains("administration"),
            notice("administration", F.concat(F.lit(prefix + "in administration ("), reason, F.lit(")"))),
        )
        .when(
            status.contains("voluntary-arrangement"),
            notice("administration", F.lit(prefix + "company voluntary arrangement (CVA)")),
        )
    )

    def overdue(part: str, kind: str, text: str) -> Column:
        due = F.coalesce(profile[part]["next_due"], F.lit("?"))
        return F.when(
            profile[part]["overdue"],
            notice(kind, F.concat(F.lit(f"{prefix}{text} overdue (next due "), due, F.lit(")"))),
        )

    cases = F.when(
        insolvency_cases > 0,
        notice(
            "insolvency",
            F.concat(F.lit(prefix), insolvency_cases.cast("string"), F.lit(" insolvency case(s) on file")),
        ),
    )
    return F.array_compact(
        F.array(
            state,
            overdue("accounts", "accounts_overdue", "accounts"),
            overdue("confirmation_statement", "confirmation_overdue", "confirmation statement"),
            cases,
        )
    )

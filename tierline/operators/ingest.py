"""Landed files folded into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grades import (
    is_grade_drop,
    normalise_grade,
    parse_inspection_date,
    safeguarding,
    synthesise_overall,
)
from ..functions.links import PROVIDER_FILE, parse_link_text
from ..functions.register import (
    classify_scope,
    join_nonblank,
    map_institution_type,
    map_provider_type,
    map_register_type,
    merge_tags,
    parse_age,
    pick,
    repair_report_url,
)
from ..functions.text import present, strip
from ..session import cut_lineage
from ..sources.pages import extract_links
from .buckets import BucketedTable
from .components import first_come
from .joins import resolve_by_keys
from .upsert import surrogate_id, upsert

# ---- fixed values: header aliases of the inspection files ------------------
START_DATE = [
    "Inspection start date",
    "Inspection start date of latest OEIF graded inspection",
    "First day of inspection",
    "Inspection date",
    "Date of latest section 5 inspection",
    "Latest inspection start date",
    "Latest inspection date",
]
REPORT_LINK = [
    "Web Link",
    "Web Link (opens in new window)",
    "URL",
    "Inspection URL",
    "Web link to latest report",
    "Latest inspection web link",
]
GRADE_ALIASES = {
    "quality_of_education": [
        "Quality of education",
        "Curriculum and teaching",
        "Education programmes for young people - achievement",
        "Education programmes for young people -  curriculum teaching and training",
    ],
    "behaviour_attitudes": [
        "Behaviour and attitudes", "Behaviour & attitudes", "Attendance and behaviour", "Inclusion",
    ],
    "personal_development": [
        "Personal development",
        "Personal development and wellbeing",
        "Education programmes for young people - participation and development",
    ],
    "leadership_management": [
        "Leadership and management", "Leadership and governance", "Contribution to meeting skills needs",
    ],
    "sixth_form_provision": ["Sixth form provision"],
    "apprenticeships": [
        "Apprenticeships",
        "Apprenticeship provision",
        "Apprenticeships -  achievement",
        "Apprenticeships - participation and development",
    ],
    "adult_learning_programmes": [
        "Adult learning programmes",
        "Adult learning",
        "Adult learning programmes - achievement",
        "Adult learning programmes - participation and development",
    ],
    "inclusion": ["Inclusion"],
    "attendance_behaviour": ["Attendance and behaviour"],
    "personal_dev_wellbeing": ["Personal development and wellbeing"],
    "achievement": ["Achievement", "Education programmes for young people - achievement"],
    "curriculum_teaching": [
        "Curriculum and teaching",
        "Education programmes for young people -  curriculum teaching and training",
    ],
    "young_peoples_provision": [
        "Education programmes for young people",
        "Education programmes for young people - participation and development",
    ],
    "high_needs_provision": [
        "Provision for learners and apprentices with high needs",
        "Provision for learners with high needs - achievement",
        "Provision for learners with high needs - participation and development",
    ],
    "contribution_to_skills": ["Contribution to meeting skills needs"],
}
STATED_OVERALL = [
    "Overall effectiveness", "Latest inspection overall effectiveness", "Overall Effectiveness",
]
PREVIOUS_OVERALL = [
    "Previous full inspection overall effectiveness",
    "Previous overall effectiveness",
    "Previous full inspection grade",
]
#: Judgements an unstated overall grade is synthesised from, in this order.
SYNTHESIS_ORDER = [
    "quality_of_education", "behaviour_attitudes", "personal_development", "leadership_management",
    "apprenticeships", "adult_learning_programmes",
]
INSPECTION_TYPE = ["Inspection type", "Latest inspection type", "Event type grouping"]
PUBLISHED = ["Publication date", "Date published"]
REGISTER_COLUMNS = {
    "region": "GOR (name)",
    "local_authority": "LA (name)",
    "postcode": "Postcode",
    "phone": "TelephoneNum",
    "website": "SchoolWebsite",
    "general_email": "SchoolEmail",
    "gender": "Gender (name)",
    "religious_character": "ReligiousCharacter (name)",
}
ADDRESS_PARTS = ["Street", "Locality", "Town", "County (name)"]
HEAD_PARTS = ["HeadTitle (name)", "HeadFirstName", "HeadLastName"]
EVENT_KEY = ["institution_id", "inspection_start_date", "inspection_body"]
# ---------------------------------------------------------------------------


def register_rows(register: DataFrame) -> DataFrame:
    """Raw school-register columns -> institution rows that are in scope."""

    def raw(name: str):
        return pick(register, name, null_word=None, loose=False)

    high_age = parse_age(raw("StatutoryHighAge"))
    scope = classify_scope(
        raw("EstablishmentStatus (name)"), raw("PhaseOfEducation (name)"), raw("TypeOfEstablishment (name)"), high_age
    )
    urn = raw("URN")
    keep = [c for c in ("row_no",) if c in register.columns]
    return (
        register.where(urn.isNotNull() & scope["in_scope"])
        .select(
            urn.alias("urn"),
            F.coalesce(raw("EstablishmentName"), F.concat(F.lit("URN "), urn)).alias("name"),
            map_institution_type(raw("TypeOfEstablishment (name)")).alias("type"),
            raw("PhaseOfEducation (name)").alias("phase"),
            *[raw(source).alias(name) for name, source in REGISTER_COLUMNS.items()],
            join_nonblank(", ", *[raw(p) for p in ADDRESS_PARTS]).alias("address"),
            join_nonblank(" ", *[raw(p) for p in HEAD_PARTS]).alias("head_name"),
            F.lit(True).alias("in_scope"),
            F.lit(None).cast("string").alias("out_of_scope_reason"),
            F.lit("gias").alias("source"),
            *keep,
        )
        .withColumn("id", surrogate_id("urn", "urn"))
    )


def ingest_register(register: DataFrame, institutions: DataFrame) -> DataFrame:
    rows = register_rows(register)
    updated = [c for c in rows.columns if c not in ("urn", "id", "row_no")]
    return upsert(
        institutions, rows, ["urn"], overwrite=updated, order="row_no" if "row_no" in rows.columns else None,
        null_keys=True,
    )


def merge_register(register: DataFrame, institutions: DataFrame) -> DataFrame:
    """Approved providers (ukprn, name, application_type, row_no) folded in.

    A known provider gets the register tag and may only be promoted to
    employer; an unknown one is created.
    """
    rows = register.withColumn("ukprn", strip(F.col("ukprn"))).where(present(F.col("ukprn")))
    kind = map_register_type(F.coalesce("application_type", F.lit("")))
    offered = rows.groupBy("ukprn").agg(
        F.min_by(F.col("name"), F.col("row_no")).alias("__name"), F.max(kind == "employer").alias("__employer")
    )
    known = institutions.join(
        offered, F.coalesce(institutions["ukprn"], F.concat(F.lit("\x00"), institutions["id"])) == offered["ukprn"], "left"
    ).drop(offered["ukprn"])
    seen = F.col("__employer").isNotNull()
    updated = known.withColumns(
        {
            "source": F.when(seen, merge_tags(F.col("source"), F.lit("apar"))).otherwise(F.col("source")),
            "type": F.when(F.col("__employer"), "employer").otherwise(F.col("type")),
        }
    ).select(*institutions.columns)
    new = (
        offered.join(institutions.where(F.col("ukprn").isNotNull()).select("ukprn"), "ukprn", "left_anti")
        .withColumns(
            {
                "id": surrogate_id("ukprn", "ukprn"),
                "name": strip(F.coalesce(F.when(F.col("__name") != "", F.col("__name")), F.concat(F.lit("UKPRN "), F.col("ukprn")))),
                "type": F.when(F.col("__employer"), "employer").otherwise("itp"),
                "phase": F.lit("16 plus"),
                "in_scope": F.lit(True),
                "source": F.lit("apar"),
            }
        )
        .drop("__name", "__employer")
    )
    types = dict(institutions.dtypes)
    shaped = new.select(
        *[(F.col(c) if c in new.columns else F.lit(None)).cast(types[c]).alias(c) for c in institutions.columns]
    )
    return updated.unionByName(shaped)


def _news_rows(found: DataFrame, title_width: int | None) -> DataFrame:
    return found.withColumns(
        {
            "title": F.col("title") if title_width is None else F.substring("title", 1, title_width),
            "trigger_severity": F.lit(0),
            "id": surrogate_id("news", "url", "institution_id"),
        }
    )


def _news_fields(trade_feed: bool) -> list[str]:
    return ["title", "excerpt", "published_at"] + (["relevance", "content_hash"] if trade_feed else [])


def merge_news(news: DataFrame, found: DataFrame, trade_feed: bool = True, title_width: int | None = None) -> DataFrame:
    """News rows (url, institution_id, ..., row_no) inserted or refreshed.

    On a re-sight the text fields are refreshed; relevance only by the trade
    feeds, whose estimate is computed anew each time. Titles are stored whole
    unless ``title_width`` is given.
    """
    rows = _news_rows(found, title_width)
    return upsert(news, rows, ["url", "institution_id"], overwrite=_news_fields(trade_feed), order="row_no")


def merge_news_stored(table: BucketedTable, found: DataFrame, trade_feed: bool = True, title_width: int | None = None) -> list[int]:
    """:func:`merge_news` into a stored table; returns the buckets that were read and written."""
    rows = _news_rows(found, title_width)
    return table.upsert(rows, ["url", "institution_id"], overwrite=_news_fields(trade_feed), order="row_no")


def inspection_rows(raw: DataFrame, further_education: bool, framework: str) -> DataFrame:
    """Inspection-file columns by alias -> typed event rows (undated included)."""

    def p(*aliases: str):
        return pick(raw, *aliases)

    grades = {name: normalise_grade(p(*aliases)) for name, aliases in GRADE_ALIASES.items()}
    urn, ukprn = p("URN", "Provider URN"), p("UKPRN", "Provider UKPRN")
    overall = synthesise_overall(normalise_grade(p(*STATED_OVERALL)), *[grades[g] for g in SYNTHESIS_ORDER])
    previous = normalise_grade(p(*PREVIOUS_OVERALL))
    return raw.select(
        "row_no",
        urn.alias("urn"),
        ukprn.alias("ukprn"),
        p("Provider name", "School name").alias("name"),
        p("Region", "Government office region (GOR)").alias("region"),
        p("Local authority").alias("local_authority"),
        map_provider_type(F.coalesce(p("Provider type"), F.lit(""))).alias("type"),
        F.lit("ofsted").alias("inspection_body"),
        F.lit(framework).alias("framework"),
        p(*INSPECTION_TYPE).alias("inspection_type"),
        parse_inspection_date(p(*START_DATE)).alias("inspection_start_date"),
        parse_inspection_date(p(*PUBLISHED)).alias("publication_date"),
        repair_report_url(p(*REPORT_LINK), urn, ukprn, further_education).alias("report_url"),
        overall.alias("overall_grade"),
        *[g.alias(n) for n, g in grades.items()],
        safeguarding(p("Safeguarding is effective"), p("Safeguarding standards")).alias("safeguarding_effective"),
        previous.alias("previous_overall_grade"),
        is_grade_drop(overall, previous).alias("grade_dropped"),
    ).where(F.col("urn").isNotNull() | F.col("ukprn").isNotNull())


def missing_providers(rows: DataFrame, institutions: DataFrame) -> DataFrame:
    """Institutions to create for further-education rows nobody knows.

    Rows arrive in file order; a row creates an institution when neither its
    URN nor its UKPRN is known by then, be it from before or from a row that
    created one.
    """
    open_rows = resolve_by_keys(rows, institutions, ["urn", "ukprn"], "row_no").where(
        F.col("institution_id").isNull()
    )
    first = cut_lineage(open_rows.select("row_no", "urn", "ukprn", "name", "type", "region", "local_authority"), "providers")
    leads = first.join(first_come(first, ("urn", "ukprn"), "row_no"), "row_no", "left_semi")
    created = leads.withColumns(
        {
            "id": surrogate_id("fe", "urn", "ukprn"),
            "name": F.coalesce("name", F.concat(F.lit("UKPRN "), F.coalesce("ukprn", "urn"))),
            "phase": F.lit("16 plus"),
            "in_scope": F.lit(True),
            "source": F.lit("ofsted_mi_fe"),
        }
    )
    types = dict(institutions.dtypes)
    return created.select(
        *[(F.col(c) if c in created.columns else F.lit(None)).cast(types[c]).alias(c) for c in institutions.columns]
    )


def ingest_inspections(
    raw: DataFrame, institutions: DataFrame, inspections: DataFrame, further_education: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(institutions, inspections) after one inspection file (with ``row_no``)."""
    framework = "feskills_2022" if further_education else "eif_2024"
    rows = inspection_rows(raw, further_education, framework)
    if further_education:
        institutions = institutions.unionByName(missing_providers(rows, institutions))
    resolved = resolve_by_keys(rows, institutions, ["urn", "ukprn"], "row_no")
    events = resolved.where(F.col("institution_id").isNotNull() & F.col("inspection_start_date").isNotNull())
    events = events.drop("urn", "ukprn", "name", "region", "local_authority", "type").withColumn(
        "id", surrogate_id("inspection", *EVENT_KEY)
    )
    updated = [c for c in events.columns if c not in (*EVENT_KEY, "id", "row_no")]
    return institutions, upsert(inspections, events, EVENT_KEY, overwrite=updated, order="row_no")


def history_rows(pages: DataFrame) -> DataFrame:
    """Provider pages (institution_id, type, html) -> dated inspection events."""
    links = extract_links(pages, "html", ("institution_id", "type"))
    links = links.where(F.col("href").rlike(PROVIDER_FILE) & F.col("text").rlike("(?i)inspect|report"))
    site = F.lit("https://reports.ofsted.gov.uk")
    rooted = F.when(F.col("href").startswith("/"), F.col("href")).otherwise(F.concat(F.lit("/"), F.col("href")))
    parsed = links.withColumn("l", parse_link_text(F.col("text"))).where(F.col("l.date").isNotNull())
    return parsed.select(
        "institution_id",
        F.lit("ofsted").alias("inspection_body"),
        F.when(F.col("type") == "itp", "feskills").otherwise("eif").alias("framework"),
        F.col("l.inspection_type").alias("inspection_type"),
        F.col("l.date").alias("inspection_start_date"),
        F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(site, rooted)).alias("report_url"),
        F.col("l.grade").alias("overall_grade"),
        # Links are applied newest first, page order among equals.
        F.col("position").alias("row_no"),
    ).withColumn("id", surrogate_id("inspection", *EVENT_KEY))


def ingest_history(pages: DataFrame, inspections: DataFrame) -> DataFrame:
    return upsert(
        inspections,
        history_rows(pages),
        EVENT_KEY,
        overwrite=["inspection_type", "report_url"],
        keep_if_null=["overall_grade"],
        order="row_no",
    )


# ---- run log ---------------------------------------------------------------
STALE_MINUTES = 60
STALE_NOTE = " [auto-marked failed: process exited without recording completion]"
INTERRUPTED_NOTE = "interrupted (process exited without recording completion)"


def close_stale_runs(runs: DataFrame, as_of: str) -> DataFrame:
    """Runs still 'running' after an hour are marked failed."""
    now = F.lit(as_of).cast("timestamp")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    stale = (F.col("status") == "running") & (age > STALE_MINUTES * 60)
    return runs.withColumns(
        {
            "error_message": F.when(stale, F.concat(F.coalesce("error_message", F.lit("")), F.lit(STALE_NOTE))).otherwise(
                F.col("error_message")
            ),
            "completed_at": F.when(stale, now.cast(dict(runs.dtypes)["completed_at"])).otherwise(F.col("completed_at")),
            "status": F.when(stale, "failed").otherwise(F.col("status")),
        }
    )


def close_interrupted(runs: DataFrame, source: str, as_of: str) -> DataFrame:
    """Before a source starts again, its runs left 'running' are closed."""
    left = (F.col("source") == source) & (F.col("status") == "running")
    now = F.lit(as_of).cast(dict(runs.dtypes)["completed_at"])
    return runs.withColumns(
        {
            "error_message": F.when(left, INTERRUPTED_NOTE).otherwise(F.col("error_message")),
            "completed_at": F.when(left, now).otherwise(F.col("completed_at")),
            "status": F.when(left, "failed").otherwise(F.col("status")),
        }
    )

"""Joins, windows, rankings, profiles and serving queries over the stored mart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators import joins as jn
from tierline.operators import ranking as rk
from tierline.operators.grams import GramIndex
from tierline.plans import Tables, briefs, dashboards, detail, lists, outreach, profiles, triggered
from tierline.plans.triggered import name_search, name_search_stored, store_name_index
from tierline.session import scratch_dir

from .q_columns import sql_label
from .q_scoring import mart
from .registry import ORACLES, SHARED, query
from .views import Views

SINCE = "2001-01-01"


class FolderTables(Tables):
    """The tables of a folder; each is made when a plan first asks for it."""

    def __init__(self, v: Views, scored: bool = True):
        vars(self).update(_views=v, _scored=scored)

    institutions = property(lambda self: self._views.institutions)
    inspections = property(lambda self: self._views.inspections)
    findings = property(lambda self: self._views.findings)
    matches = property(lambda self: self._views.matches)
    notices = property(lambda self: self._views.notices)
    news = property(lambda self: self._views.news)
    scores = property(lambda self: mart(self._views) if self._scored else None)
    runs = property(lambda self: self._views.runs)


def tables(v: Views, scored: bool = True) -> Tables:
    return FolderTables(v, scored)


def joined(df: DataFrame) -> DataFrame:
    return df.withColumn("critical_signals", F.array_join("critical_signals", " · "))


N = "CAST(count(*) AS BIGINT)"


def cnt(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


SHARED["evid"] = """SELECT i.*,
  EXISTS (SELECT 1 FROM {inspections} n WHERE n.institution_id = i.id) AS any_inspection,
  EXISTS (SELECT 1 FROM {inspections} n WHERE n.institution_id = i.id AND n.report_url IS NOT NULL) AS with_report_url,
  EXISTS (SELECT 1 FROM {notices} c WHERE c.institution_id = i.id AND c.withdrawn_at IS NULL) AS with_active_compliance,
  EXISTS (SELECT 1 FROM {news} w WHERE w.institution_id = i.id AND w.trigger_severity >= 50) AS with_news_signal
  FROM {institutions} i"""
SHARED["act"] = "SELECT * FROM {evid} WHERE with_report_url OR with_active_compliance OR with_news_signal"
SHARED["lst"] = """SELECT institution_id AS iid, id AS latest_inspection_id, overall_grade AS latest_grade, inspection_start_date AS latest_inspection_date_,
  report_url AS latest_report_url, publication_date FROM {sc_latest}"""


# ---- joins ------------------------------------------------------------------


@query("inspection_facts", "SELECT n.id, n.overall_grade, i.name, i.type FROM {inspections} n JOIN {institutions} i ON i.id = n.institution_id WHERE i.in_scope")
def _(v: Views) -> DataFrame:
    dim = v.institutions.where(F.col("in_scope")).select(F.col("id").alias("institution_id"), "name", "type")
    return v.inspections.join(dim, "institution_id").select("id", "overall_grade", "name", "type")


@query("scored_or_not", "SELECT i.id, i.type, s.tier, s.score FROM {institutions} i LEFT JOIN {scores} s ON s.institution_id = i.id")
def _(v: Views) -> DataFrame:
    return tables(v).scored("left").select("id", "type", "tier", "score")


@query(
    "resolve_by_keys",
    """SELECT m.id, coalesce((SELECT min(i.id) FROM {institutions} i WHERE i.urn = nullif(m.urn, '')), (SELECT min(i.id) FROM {institutions} i WHERE i.ukprn = m.ukprn)) AS resolved
       FROM {messy} m""",
)
def _(v: Views) -> DataFrame:
    rows = v.messy.select("id", F.when(F.col("urn") != "", F.col("urn")).alias("urn"), "ukprn")
    return jn.resolve_by_keys(rows, v.institutions.select("id", "urn", "ukprn"), ["urn", "ukprn"], "id", "resolved").select("id", "resolved")


@query("actionable", "SELECT id, name FROM {act}")
def _(v: Views) -> DataFrame:
    return jn.actionable(v.institutions, v.inspections, v.notices, v.news).select("id", "name")


@query("actionable_universities", "SELECT id FROM {evid} WHERE type = 'university' AND (with_report_url OR with_active_compliance OR with_news_signal OR apprenticeship_standards >= 5)")
def _(v: Views) -> DataFrame:
    return jn.actionable(v.institutions.where("type = 'university'"), v.inspections, v.notices, v.news, 5).select("id")


@query("without_evidence", "SELECT id FROM {evid} WHERE NOT (with_report_url OR with_active_compliance OR with_news_signal)")
def _(v: Views) -> DataFrame:
    return jn.without_evidence(v.institutions, v.inspections, v.notices, v.news).select("id")


@query("key_lookup", "SELECT m.id, i.id AS institution_id FROM {messy} m JOIN {institutions} i ON i.ukprn = m.ukprn")
def _(v: Views) -> DataFrame:
    dim = v.institutions.select("id", "ukprn")
    return jn.lookup(v.messy.select("id", "ukprn"), dim, "ukprn").select("id", "institution_id")


@query("with_latest", "SELECT i.id, l.latest_inspection_id, l.latest_grade, l.latest_inspection_date_ AS latest_inspection_date FROM {institutions} i LEFT JOIN {lst} l ON l.iid = i.id")
def _(v: Views) -> DataFrame:
    return jn.with_latest(v.institutions.select("id"), v.inspections).select("id", "latest_inspection_id", "latest_grade", "latest_inspection_date")


@query("top_notice_per_institution", "SELECT institution_id, id, severity FROM {notices} QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY severity DESC, id DESC) = 1")
def _(v: Views) -> DataFrame:
    return jn.top_by(v.notices.select("institution_id", "id", "severity"), "institution_id", "severity")


@query(
    "reference_inspection",
    """SELECT i.id, coalesce(s.last_inspection_id, l.latest_inspection_id) AS reference_inspection_id, n.overall_grade
       FROM {institutions} i LEFT JOIN {scores} s ON s.institution_id = i.id LEFT JOIN {lst} l ON l.iid = i.id
       LEFT JOIN {inspections} n ON n.id = coalesce(s.last_inspection_id, l.latest_inspection_id)""",
)
def _(v: Views) -> DataFrame:
    scores = mart(v).select("institution_id", "last_inspection_id")
    df = jn.with_reference_inspection(v.institutions.select("id"), scores, v.inspections, ["overall_grade"])
    return df.select("id", "reference_inspection_id", "overall_grade")


@query("with_news_counts", "SELECT i.id, w.n AS news_count FROM {institutions} i LEFT JOIN (SELECT institution_id, CAST(count(*) AS BIGINT) AS n FROM {news} GROUP BY 1) w ON w.institution_id = i.id")
def _(v: Views) -> DataFrame:
    return jn.with_counts(v.institutions.select("id"), v.news, "institution_id", "news_count")


@query("with_top_finding", "SELECT s.institution_id, s.top_finding_id, f.phrase_id AS top_phrase_id FROM {scores} s LEFT JOIN {findings} f ON f.id = s.top_finding_id")
def _(v: Views) -> DataFrame:
    return jn.with_top_finding(mart(v), v.findings).select("institution_id", "top_finding_id", "top_phrase_id")


# ---- windows ----------------------------------------------------------------


@query("latest_per_institution", "SELECT institution_id, id, inspection_start_date FROM {sc_latest}")
def _(v: Views) -> DataFrame:
    return rk.latest_per(v.inspections.select("institution_id", "id", "inspection_start_date"), "institution_id", "inspection_start_date")


@query("latest_run_per_source", "SELECT source, id, status FROM {runs} QUALIFY row_number() OVER (PARTITION BY source ORDER BY started_at DESC, id DESC) = 1")
def _(v: Views) -> DataFrame:
    return rk.latest_run_per_source(v.runs).select("source", "id", "status")


@query(
    "latest_with_previous",
    """SELECT institution_id, id, overall_grade, previous_overall_grade, previous_id FROM (SELECT institution_id, id, overall_grade,
       lead(overall_grade) OVER w AS previous_overall_grade, lead(id) OVER w AS previous_id, row_number() OVER w AS rn FROM {inspections}
       WINDOW w AS (PARTITION BY institution_id ORDER BY inspection_start_date DESC, id)) x WHERE rn = 1""",
)
def _(v: Views) -> DataFrame:
    df = v.inspections.select("institution_id", "id", "inspection_start_date", "overall_grade")
    return rk.with_previous(df, "institution_id", "inspection_start_date", ["overall_grade", "id"]).drop("inspection_start_date")


@query("latest_with_text", "SELECT institution_id, id FROM {inspections} WHERE id IN (SELECT doc_id FROM {documents}) QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY inspection_start_date DESC, id) = 1".replace("{documents}", "documents"))
def _(v: Views) -> DataFrame:
    parents = v.inspections.select("id", "institution_id", "inspection_start_date")
    return rk.latest_with_children(parents, v.documents, "institution_id", "inspection_start_date", "doc_id").select("institution_id", "id")


@query("top_findings_per_institution", "SELECT institution_id, id, rn AS place FROM (SELECT institution_id, id, CAST(row_number() OVER (PARTITION BY institution_id ORDER BY final_severity DESC, id) AS INT) AS rn FROM {findings}) x WHERE rn <= 4")
def _(v: Views) -> DataFrame:
    df = v.findings.select("institution_id", "id", "final_severity")
    return rk.top_n_per(df, ["institution_id"], [F.col("final_severity").desc(), F.col("id").asc()], 4, "place").drop("final_severity")


@query("latest_grade_value", "SELECT institution_id, overall_grade FROM {sc_latest}")
def _(v: Views) -> DataFrame:
    return rk.latest_value(v.inspections, "institution_id", "inspection_start_date", "overall_grade")


@query("first_and_last_news", "SELECT url, min(id) AS first_id, max(id) AS last_id FROM {news} GROUP BY url")
def _(v: Views) -> DataFrame:
    df = v.news.select("url", "id")
    first = rk.dedupe_first(df, ["url"], "id").select("url", F.col("id").alias("first_id"))
    return first.join(rk.dedupe_last(df, ["url"], "id").select("url", F.col("id").alias("last_id")), "url")


# ---- profiles ---------------------------------------------------------------


@query(
    "segments",
    f"""SELECT i.type, {N} AS institutions, CAST(count(s.score) AS BIGINT) AS scored, {cnt('s.score >= 60')} AS high,
        CAST(floor(count(s.score) / CAST(count(*) AS DOUBLE) * 100 + 0.5) AS BIGINT) AS coverage_pct
        FROM {{institutions}} i LEFT JOIN {{scores}} s ON s.institution_id = i.id WHERE i.in_scope GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.segments(tables(v))


@query(
    "kpis",
    f"""SELECT (SELECT {cnt('in_scope')} FROM {{institutions}}) AS in_scope, (SELECT {N} FROM {{inspections}}) AS inspections,
        (SELECT {cnt('NOT suppressed')} FROM {{findings}}) AS findings, (SELECT {N} FROM {{scores}}) AS scored,
        (SELECT {cnt('score >= 60')} FROM {{scores}}) AS score_60, (SELECT {cnt('score >= 80')} FROM {{scores}}) AS score_80,
        (SELECT {cnt("tier = 'critical'")} FROM {{scores}}) AS critical,
        (SELECT {cnt('in_scope AND (general_email IS NOT NULL OR head_email IS NOT NULL)')} FROM {{institutions}}) AS with_email""",
)
def _(v: Views) -> DataFrame:
    return profiles.kpis(tables(v))


@query(
    "coverage_summary",
    f"""SELECT (SELECT {cnt("type = 'itp' AND in_scope")} FROM {{institutions}}) AS total_itps, (SELECT {N} FROM {{news}}) AS news_items_total,
        (SELECT {cnt('angle IS NOT NULL')} FROM {{news}}) AS news_items_extracted, (SELECT {cnt('trigger_severity >= 70')} FROM {{news}}) AS news_items_high_signal,
        (SELECT {cnt('withdrawn_at IS NULL')} FROM {{notices}}) AS compliance_active,
        (SELECT CAST(count(DISTINCT institution_id) AS BIGINT) FROM {{notices}} WHERE withdrawn_at IS NULL) AS institutions_with_compliance,
        (SELECT CAST(count(DISTINCT institution_id) AS BIGINT) FROM {{news}} WHERE trigger_severity >= 50) AS institutions_with_news_signal""",
)
def _(v: Views) -> DataFrame:
    return profiles.coverage_summary(tables(v, False))


@query(
    "universe_summary",
    f"""SELECT {cnt("type = 'itp'")} AS itps, {cnt("type = 'university'")} AS universities, {cnt("type = 'fe_college'")} AS fe_colleges,
        {cnt("type = 'sixth_form_college'")} AS sixth_form_colleges, {cnt("type = 'employer'")} AS employers FROM {{institutions}} WHERE in_scope""",
)
def _(v: Views) -> DataFrame:
    return profiles.universe_summary(tables(v, False))


@query(
    "tier_counts",
    f"""SELECT t.tier, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES ('critical'), ('high'), ('worth_a_look'), ('skip')) t(tier)
        LEFT JOIN (SELECT s.tier, {N} AS n FROM {{act}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.type = 'itp' AND i.in_scope GROUP BY 1) c ON c.tier = t.tier""",
)
def _(v: Views) -> DataFrame:
    return profiles.tier_counts(dashboards.actionable_scored(tables(v), "itp"))


@query(
    "distinct_flagged",
    f"""SELECT (SELECT CAST(count(DISTINCT c.institution_id) AS BIGINT) FROM {{notices}} c JOIN {{institutions}} i ON i.id = c.institution_id WHERE i.type = 'itp' AND c.withdrawn_at IS NULL) AS active_compliance,
        (SELECT CAST(count(DISTINCT n.institution_id) AS BIGINT) FROM {{inspections}} n JOIN {{institutions}} i ON i.id = n.institution_id WHERE i.type = 'itp' AND n.publication_date >= '{SINCE}'
          AND n.overall_grade IN ('requires_improvement', 'inadequate')) AS recent_weak,
        (SELECT CAST(count(DISTINCT w.institution_id) AS BIGINT) FROM {{news}} w JOIN {{institutions}} i ON i.id = w.institution_id WHERE i.type = 'itp' AND w.trigger_severity >= 70 AND w.relevance >= 60) AS active_news_trigger""",
)
def _(v: Views) -> DataFrame:
    return profiles.distinct_flagged(tables(v, False), "itp", SINCE)


@query(
    "evidence_coverage",
    f"""SELECT type, {N} AS total, {cnt('any_inspection')} AS any_inspection, {cnt('with_report_url')} AS with_report_url,
        {cnt('EXISTS (SELECT 1 FROM {inspections_text} t WHERE t.institution_id = e.id AND t.report_text IS NOT NULL)')} AS with_report_text,
        {cnt('with_active_compliance')} AS with_active_compliance, {cnt('with_news_signal')} AS with_news_signal,
        {cnt('with_report_url OR with_active_compliance OR with_news_signal')} AS actionable
        FROM {{evid}} e WHERE in_scope AND type IN ('itp', 'university', 'fe_college', 'sixth_form_college', 'employer') GROUP BY type""",
)
def _(v: Views) -> DataFrame:
    t = tables(v, False)
    return profiles.evidence_coverage(Tables(t.institutions, v.inspections_text, notices=t.notices, news=t.news))


@query(
    "size_distribution",
    f"""SELECT CASE WHEN s >= 50 THEN '50+ (very large)' WHEN s >= 15 THEN '15-49 (large)' WHEN s >= 5 THEN '5-14 (medium)' WHEN s >= 1 THEN '1-4 (niche)' ELSE '0 (unknown)' END AS band,
        {N} AS n, CAST(min(s) AS INT) AS lowest FROM (SELECT coalesce(apprenticeship_standards, 0) AS s FROM {{institutions}} WHERE type = 'itp' AND in_scope) x GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.size_distribution(tables(v, False))


@query(
    "skip_sizes",
    f"""SELECT CASE WHEN s >= 10 THEN 'large skip' WHEN s >= 3 THEN 'medium skip' WHEN s >= 1 THEN 'niche skip' ELSE 'tiny / unknown' END AS size_band, {N} AS n, CAST(min(s) AS INT) AS lowest
        FROM (SELECT coalesce(i.apprenticeship_standards, 0) AS s FROM {{institutions}} i JOIN {{scores}} o ON o.institution_id = i.id WHERE i.type = 'itp' AND i.in_scope AND o.tier = 'skip') x GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.skip_sizes(tables(v))


@query(
    "trigger_distribution",
    f"""SELECT CASE WHEN trigger_severity >= 90 THEN '90+ (immediate trigger)' WHEN trigger_severity >= 70 THEN '70-89 (warm trigger)' WHEN trigger_severity >= 40 THEN '40-69 (mild trigger)'
        ELSE '<40 (no trigger)' END AS band, {N} AS n, min(trigger_severity) AS lowest FROM {{news}} WHERE angle IS NOT NULL GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.trigger_distribution(tables(v, False))


@query(
    "critical_reasons",
    f"""SELECT CASE WHEN urgency_score >= 90 THEN 'urgency 90+ (Inadequate / safeguarding fail / 2+ critical signals)' WHEN urgency_score >= 70 THEN 'urgency 70-89 (RI signals)'
        WHEN urgency_score >= 50 THEN 'urgency 50-69 (weaker signal)' WHEN pipeline_value_score >= 90 THEN 'pipeline 90+ (no inspection urgency, big provider)'
        WHEN pipeline_value_score >= 70 THEN 'pipeline 70-89' ELSE 'other' END AS reason, {N} AS itps
        FROM {{scores}} s JOIN {{institutions}} i ON i.id = s.institution_id WHERE i.type = 'itp' AND i.in_scope AND s.tier = 'critical' GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.critical_reasons(tables(v))


@query(
    "score_histogram",
    f"SELECT CAST(floor(s.score / 5.0) * 5 AS BIGINT) AS score_band, {N} AS itps FROM {{scores}} s JOIN {{institutions}} i ON i.id = s.institution_id WHERE i.type = 'itp' AND i.in_scope GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    return profiles.score_histogram(tables(v))


@query(
    "score_by_grade",
    f"""SELECT coalesce(l.latest_grade, 'no_inspection') AS grade, {N} AS n, round(avg(s.score), 0) AS avg_score, max(s.score) AS max_score, min(s.score) AS min_score
        FROM {{institutions}} i JOIN {{scores}} s ON s.institution_id = i.id LEFT JOIN {{lst}} l ON l.iid = i.id WHERE i.type = 'itp' AND i.in_scope GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.score_by_grade(tables(v))


@query(
    "tier_distribution",
    f"""SELECT coalesce(s.tier, 'unscored') AS tier, {N} AS n, round(avg(s.score), 1) AS avg_score, round(avg(s.urgency_score), 1) AS avg_urgency, round(avg(s.pipeline_value_score), 1) AS avg_pipeline
        FROM {{institutions}} i LEFT JOIN {{scores}} s ON s.institution_id = i.id WHERE i.type = 'itp' AND i.in_scope GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.tier_distribution(tables(v))


@query("grade_distribution", f"SELECT coalesce(l.latest_grade, 'no_inspection') AS latest_grade, {N} AS n FROM {{institutions}} i LEFT JOIN {{lst}} l ON l.iid = i.id WHERE i.type = 'itp' AND i.in_scope GROUP BY 1")
def _(v: Views) -> DataFrame:
    return profiles.grade_distribution(tables(v, False))


@query("duplicate_news", f"SELECT url, institution_id, {N} AS dups FROM {{news}} GROUP BY 1, 2 HAVING count(*) > 1")
def _(v: Views) -> DataFrame:
    return profiles.duplicates(v.news, ["url", "institution_id"])


@query(
    "duplicate_summary",
    f"""SELECT {N} AS total_rows, CAST(count(DISTINCT url || '|' || CAST(institution_id AS VARCHAR)) AS BIGINT) AS distinct_url_inst,
        CAST(count(DISTINCT title || '|' || CAST(institution_id AS VARCHAR)) AS BIGINT) AS distinct_title_inst FROM {{news}}""",
)
def _(v: Views) -> DataFrame:
    return profiles.duplicate_summary(v.news)


@query("uncovered", "SELECT id, name, apprenticeship_standards FROM {institutions} i WHERE type = 'university' AND in_scope AND NOT EXISTS (SELECT 1 FROM {news} n WHERE n.institution_id = i.id)")
def _(v: Views) -> DataFrame:
    return profiles.uncovered(tables(v, False), "university")


@query("total_standards", "SELECT CAST(sum(apprenticeship_standards) AS BIGINT) AS total_standards FROM {institutions} WHERE type = 'university' AND in_scope")
def _(v: Views) -> DataFrame:
    return profiles.total_standards(tables(v, False), "university")


@query(
    "register_status_counts",
    f"""SELECT trim(application_type) AS application_type, trim(register_status) AS status, {N} AS n, CAST(sum(count(*)) OVER (PARTITION BY trim(register_status)) AS BIGINT) AS status_total
        FROM {{messy}} GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    return profiles.status_counts(v.messy.select("application_type", F.col("register_status").alias("status")))


@query("register_status_samples", "SELECT trim(register_status) AS status, id FROM {messy} QUALIFY row_number() OVER (PARTITION BY trim(register_status) ORDER BY id) <= 3")
def _(v: Views) -> DataFrame:
    df = v.messy.select("id", F.col("id").alias("row_no"), F.col("register_status").alias("status"))
    return profiles.status_samples(df, n=3).select("status", "id")


@query("notice_profile", f"SELECT notice_body, notice_type, {N} AS notices, round(avg(severity), 0) AS avg_severity, {cnt('withdrawn_at IS NULL')} AS active FROM {{notices}} GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return profiles.notice_profile(v.notices)


@query("news_profile", f"SELECT source, {N} AS items, round(avg(relevance), 0) AS avg_relevance, {cnt('trigger_severity >= 70')} AS high_severity FROM {{news}} GROUP BY 1")
def _(v: Views) -> DataFrame:
    return profiles.news_profile(v.news)


@query("news_by_type", f"SELECT i.type, CAST(count(DISTINCT i.id) AS BIGINT) AS institutions_with_news, {N} AS news_items FROM {{news}} n JOIN {{institutions}} i ON i.id = n.institution_id GROUP BY 1")
def _(v: Views) -> DataFrame:
    return profiles.news_by_type(tables(v, False))


@query(
    "completeness",
    f"""SELECT {N} AS total, {cnt('in_scope')} AS in_scope, CAST(count(ukprn) AS BIGINT) AS with_ukprn, CAST(count(website) AS BIGINT) AS with_website, CAST(count(general_email) AS BIGINT) AS with_general_email,
        CAST(count(head_email) AS BIGINT) AS with_head_email, {cnt('apprenticeship_standards > 0')} AS with_standards FROM {{institutions}} WHERE type = 'itp'""",
)
def _(v: Views) -> DataFrame:
    return profiles.completeness(tables(v, False))


@query(
    "report_coverage",
    f"""SELECT {N} AS total_inspections, CAST(count(report_text) AS BIGINT) AS with_report_text, CAST(count(report_url) AS BIGINT) AS with_report_url
        FROM {{inspections_text}} n JOIN {{institutions}} i ON i.id = n.institution_id WHERE i.type = 'itp'""",
)
def _(v: Views) -> DataFrame:
    return profiles.report_coverage(Tables(v.institutions, v.inspections_text))


@query("extract_progress", f"SELECT CAST(count(angle) AS BIGINT) AS extracted, {cnt('angle IS NULL')} AS pending, {N} AS total FROM {{news}}")
def _(v: Views) -> DataFrame:
    return profiles.extract_progress(v.news)


@query("withdrawn_progress", f"SELECT {cnt('withdrawn_at IS NULL')} AS active, CAST(count(withdrawn_at) AS BIGINT) AS withdrawn, {N} AS total FROM {{notices}} WHERE notice_body = 'esfa'")
def _(v: Views) -> DataFrame:
    return profiles.withdrawn_progress(v.notices, "esfa")


@query("type_counts", f"SELECT type, {N} AS total, {cnt('in_scope')} AS in_scope FROM {{institutions}} GROUP BY 1")
def _(v: Views) -> DataFrame:
    return profiles.type_counts(tables(v, False))


SHARED["gate"] = """SELECT *, regexp_matches(title || ' ' || coalesce(excerpt, ''),
  '(?i)strik|ballot|principal|appoint|ofsted|inspection report|merger|merging|fund|audit|harm|concern|fall|fell|loss|loan') AS hit FROM {news}"""


@query(
    "evaluate_gate",
    f"""SELECT {N} AS total, {cnt('hit')} AS would_extract, {cnt('NOT hit')} AS would_skip, {cnt('hit AND trigger_severity >= 70')} AS kept_high, {cnt('NOT hit AND trigger_severity >= 70')} AS lost_high FROM {{gate}}""",
)
def _(v: Views) -> DataFrame:
    return profiles.evaluate_gate(v.news)


@query("gate_losses", "SELECT id, title, trigger_severity, angle FROM {gate} WHERE trigger_severity >= 70 AND NOT hit")
def _(v: Views) -> DataFrame:
    return profiles.gate_losses(v.news)


@query(
    "news_counts",
    f"""SELECT i.id, i.name, CAST(count(n.id) AS BIGINT) AS news_count, {cnt('n.trigger_severity >= 50')} AS signal_count FROM {{institutions}} i LEFT JOIN {{news}} n ON n.institution_id = i.id
        WHERE i.type = 'university' AND i.in_scope GROUP BY 1, 2 ORDER BY signal_count DESC, news_count DESC, i.id LIMIT 15""",
)
def _(v: Views) -> DataFrame:
    return profiles.news_counts(tables(v, False), "university", n=15)


@query(
    "cohort_counts",
    f"""SELECT i.type, s.tier, {N} AS n FROM {{institutions}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.in_scope AND (s.tier IN ('critical', 'high') OR (s.tier = 'worth_a_look' AND i.type = 'itp')) GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    return profiles.cohort_counts(tables(v))


@query(
    "landscape",
    f"""SELECT {N} AS inspections, {cnt(f"n.publication_date >= '{SINCE}'")} AS last_12m, {cnt("n.overall_grade IN ('requires_improvement', 'inadequate')")} AS ri_or_inadequate,
        {cnt('n.grade_dropped')} AS grade_dropped, {cnt('NOT n.safeguarding_effective')} AS safeguarding_not_met FROM {{inspections}} n JOIN {{institutions}} i ON i.id = n.institution_id WHERE i.type = 'itp'""",
)
def _(v: Views) -> DataFrame:
    return profiles.landscape(tables(v, False), SINCE)


@query(
    "news_coverage",
    f"""SELECT i.type, {N} AS total, {cnt('w.n > 0')} AS with_news, {cnt('w.n IS NULL')} AS no_news_yet FROM {{institutions}} i
        LEFT JOIN (SELECT institution_id, count(*) AS n FROM {{news}} GROUP BY 1) w ON w.institution_id = i.id WHERE i.in_scope GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    return profiles.news_coverage(tables(v, False))


# ---- lists, queues, feeds ---------------------------------------------------

_LIST_ORDER = "coalesce(s.score, -1) DESC, coalesce(s.inspection_count, 0) DESC, i.name, i.id"


@query(
    "opportunity_list",
    f"""WITH p AS (SELECT i.id, i.name, s.score, s.tier, s.last_inspection_id, s.top_finding_id, row_number() OVER (ORDER BY {_LIST_ORDER}) AS rn
          FROM {{act}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.in_scope)
        SELECT p.id, p.name, p.score, p.tier, n.overall_grade, n.report_url, f.phrase_id AS top_phrase_id FROM p LEFT JOIN {{inspections}} n ON n.id = p.last_inspection_id
        LEFT JOIN {{findings}} f ON f.id = p.top_finding_id WHERE rn BETWEEN 31 AND 60""",
)
def _(v: Views) -> DataFrame:
    return lists.opportunity_list(tables(v), number=2).select("id", "name", "score", "tier", "overall_grade", "report_url", "top_phrase_id")


@query("opportunity_list_stored", ORACLES["opportunity_list"])
def _(v: Views) -> DataFrame:
    """The same page from a stored ranking of the whole list."""
    ranking = lists.opportunity_ranking(tables(v), scratch_dir(v.spark, "ranking"))
    return lists.opportunity_list(tables(v), number=2, ranking=ranking).select("id", "name", "score", "tier", "overall_grade", "report_url", "top_phrase_id")


@query(
    "opportunity_list_by_type",
    f"""WITH p AS (SELECT i.id, i.name, s.score, s.tier, coalesce(s.last_inspection_id, l.latest_inspection_id) AS ref, row_number() OVER (ORDER BY {_LIST_ORDER}) AS rn
          FROM {{institutions}} i LEFT JOIN {{scores}} s ON s.institution_id = i.id LEFT JOIN {{lst}} l ON l.iid = i.id WHERE i.in_scope AND i.type = 'state_school')
        SELECT p.id, p.name, p.score, p.tier, n.overall_grade FROM p LEFT JOIN {{inspections}} n ON n.id = p.ref WHERE rn <= 30""",
)
def _(v: Views) -> DataFrame:
    return lists.opportunity_list(tables(v), type="state_school").select("id", "name", "score", "tier", "overall_grade")


@query(
    "filter_opportunities",
    """SELECT i.id, s.score FROM {institutions} i JOIN {scores} s ON s.institution_id = i.id WHERE (i.name ILIKE '%an%' OR i.postcode ILIKE '%an%') AND i.region IN ('ASIA') AND s.score >= 60 AND s.score <= 95
       AND (i.general_email IS NOT NULL OR i.head_email IS NOT NULL)""",
)
def _(v: Views) -> DataFrame:
    df = lists.filter_opportunities(tables(v).scored(), q="AN", region="ASIA", min_score=60, max_score=95, has_email=True)
    return df.select("id", "score")


@query("opportunity_total", f"SELECT {N} AS total FROM {{act}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.in_scope AND s.tier = 'critical'")
def _(v: Views) -> DataFrame:
    return lists.opportunity_total(tables(v), tier="critical")


EXPORT = f"""WITH p AS (SELECT i.id, i.name, i.type, i.region, i.local_authority, i.postcode, i.ukprn, i.urn, i.head_name, i.head_email, i.general_email, i.phone, i.website, s.* EXCLUDE (institution_id)
          FROM {{institutions}} i JOIN {{scores}} s ON s.institution_id = i.id ),
        c AS (SELECT institution_id, count(*) AS n, max(severity) AS sev, arg_max(subject, CAST(severity AS BIGINT) * 1000000000 + id) AS subj, arg_max(source_url, CAST(severity AS BIGINT) * 1000000000 + id) AS url FROM {{notices}} WHERE withdrawn_at IS NULL GROUP BY 1),
        w AS (SELECT institution_id, count(*) AS n, max(trigger_severity) AS sev, max(CASE WHEN rn = 1 THEN title END) AS title, max(CASE WHEN rn = 1 THEN curricula_tagged END) AS cur, max(CASE WHEN rn = 1 THEN angle END) AS angle, max(CASE WHEN rn = 1 THEN url END) AS url
          FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY trigger_severity DESC, id DESC) AS rn FROM {{news}} WHERE relevance >= 50 AND trigger_severity > 0) x GROUP BY 1)
        SELECT p.name, p.type, p.region, p.local_authority, p.postcode, p.ukprn, p.urn, p.head_name, p.head_email, p.general_email, p.phone, p.website, p.tier, p.score, p.urgency_score, p.pipeline_value_score, p.raw_score,
          p.top_curriculum, p.top_curriculum_score, p.finding_count, {sql_label('n.overall_grade')} AS current_grade, {sql_label('n.previous_overall_grade')} AS previous_grade,
          CASE WHEN n.grade_dropped THEN 'yes' ELSE 'no' END AS grade_dropped, n.inspection_start_date AS latest_inspection_date, n.report_url, coalesce(f.phrase_id, '') AS top_weakness_phrase,
          coalesce(f.source_quote, '') AS top_weakness_quote, CAST(coalesce(c.n, 0) AS BIGINT) AS active_compliance_count, coalesce(c.subj, '') AS compliance_top_subject, coalesce(CAST(c.sev AS VARCHAR), '') AS compliance_top_severity,
          coalesce(c.url, '') AS compliance_top_url, CAST(coalesce(w.n, 0) AS BIGINT) AS active_news_count, coalesce(w.title, '') AS news_top_title, coalesce(CAST(w.sev AS VARCHAR), '') AS news_top_severity,
          coalesce(w.cur, '') AS news_top_curricula, coalesce(w.angle, '') AS news_top_angle, coalesce(w.url, '') AS news_top_url, coalesce(array_to_string(p.critical_signals, ' · '), '') AS critical_signals
        FROM p LEFT JOIN {{inspections}} n ON n.id = p.last_inspection_id LEFT JOIN {{findings}} f ON f.id = p.top_finding_id LEFT JOIN c ON c.institution_id = p.id LEFT JOIN w ON w.institution_id = p.id"""


@query("opportunity_export", EXPORT)
def _(v: Views) -> DataFrame:
    return lists.opportunity_export(tables(v))


@query(
    "top_opportunities",
    """SELECT i.id, i.name, i.region, i.type, s.score, s.urgency_score, s.inspection_count, s.top_curriculum, n.overall_grade AS current_grade, s.finding_count
       FROM {scores} s JOIN {institutions} i ON i.id = s.institution_id LEFT JOIN {inspections} n ON n.id = s.last_inspection_id WHERE i.in_scope
       ORDER BY s.score DESC, s.urgency_score DESC, s.inspection_count DESC, i.id LIMIT 6""",
)
def _(v: Views) -> DataFrame:
    return lists.top_opportunities(tables(v), n=6)


@query("distinct_regions", "SELECT DISTINCT region FROM {institutions} i JOIN {scores} s ON s.institution_id = i.id WHERE in_scope AND region <> ''")
def _(v: Views) -> DataFrame:
    return lists.distinct_regions(tables(v))


_COHORT = """SELECT i.id, i.name, i.ukprn, i.postcode, i.general_email, i.apprenticeship_standards, s.tier, s.score, s.urgency_score, s.pipeline_value_score, s.top_curriculum,
  array_to_string(s.critical_signals, ' · ') AS critical_signals, l.latest_grade, l.latest_inspection_date_ AS latest_inspection_date"""


def _cohort_sql(source: str, kind: str, where: str, order: str, limit: str = "") -> str:
    return f"{_COHORT} FROM {{{source}}} i {kind} JOIN {{scores}} s ON s.institution_id = i.id LEFT JOIN {{lst}} l ON l.iid = i.id WHERE i.in_scope AND {where} ORDER BY {order} {limit}"


_URGENT = "s.urgency_score DESC, s.score DESC, i.id"
_SIZE = "i.apprenticeship_standards DESC NULLS LAST, i.id"
_SHOWN = {"high": 30, "outstanding": 20, "major": 25, "by_score": 10, "by_size": 30}
for _kind, _sql in {
    "critical": _cohort_sql("act", "", "i.type = 'itp' AND s.tier = 'critical'", _URGENT),
    "high": _cohort_sql("act", "", "i.type = 'itp' AND s.tier = 'high'", _URGENT, "LIMIT 30"),
    "outstanding": _cohort_sql("institutions", "", "i.type = 'itp' AND l.latest_grade = 'outstanding'", "l.latest_inspection_date_ DESC, i.id", "LIMIT 20"),
    "major": _cohort_sql("act", "", "i.type = 'itp'", _SIZE, "LIMIT 25"),
    "by_score": _cohort_sql("institutions", "", "i.type = 'itp'", "s.score DESC, s.urgency_score DESC, i.id", "LIMIT 10"),
    "by_size": _cohort_sql("institutions", "LEFT", "i.type = 'itp'", _SIZE, "LIMIT 30"),
}.items():
    query(f"cohort_{_kind}", _sql)(lambda v, k=_kind: joined(lists.cohort_ranking(tables(v), k, _SHOWN.get(k))))


@query(
    "cohort_universities",
    """SELECT i.id, i.name, s.tier, s.score FROM {evid} i LEFT JOIN {scores} s ON s.institution_id = i.id WHERE i.type = 'university' AND i.in_scope
       AND (with_report_url OR with_active_compliance OR with_news_signal OR i.apprenticeship_standards >= 5)""",
)
def _(v: Views) -> DataFrame:
    return lists.cohort_ranking(tables(v), "universities").select("id", "name", "tier", "score")


@query("cohort_outreach_ids", f"SELECT i.id, i.name FROM {{institutions}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.in_scope AND s.tier = 'critical' AND i.type IN ('itp', 'fe_college') ORDER BY {_URGENT} LIMIT 5")
def _(v: Views) -> DataFrame:
    return lists.cohort_ranking(tables(v), "outreach_ids", n=5).select("id", "name")


@query("rank_by_tier", _cohort_sql("act", "LEFT", "i.type = 'itp'", "i.id"))
def _(v: Views) -> DataFrame:
    return joined(lists.rank_by_tier(tables(v)))


@query(
    "notice_feed",
    """SELECT c.id, c.institution_id, i.name, c.notice_type, c.severity, c.subject, c.issued_at FROM {notices} c JOIN {institutions} i ON i.id = c.institution_id
       WHERE i.type = 'itp' AND c.withdrawn_at IS NULL ORDER BY c.severity DESC, c.issued_at DESC NULLS LAST, c.id LIMIT 20""",
)
def _(v: Views) -> DataFrame:
    return lists.signal_feed(tables(v, False), "itp", "notices", n=20).select("id", "institution_id", "name", "notice_type", "severity", "subject", "issued_at")


@query(
    "news_feed",
    """SELECT c.id, c.institution_id, i.name, c.title, c.trigger_severity, c.published_at FROM {news} c JOIN {institutions} i ON i.id = c.institution_id
       WHERE i.type = 'itp' AND c.trigger_severity >= 50 AND c.relevance >= 50 ORDER BY c.trigger_severity DESC, c.published_at DESC NULLS LAST, c.id LIMIT 20""",
)
def _(v: Views) -> DataFrame:
    return lists.signal_feed(tables(v, False), "itp", "news", n=20).select("id", "institution_id", "name", "title", "trigger_severity", "published_at")


@query(
    "pending_queue",
    """SELECT n.id, n.institution_id, i.name AS institution_name FROM {news} n JOIN {institutions} i ON i.id = n.institution_id LEFT JOIN {scores} s ON s.institution_id = n.institution_id
       WHERE n.angle IS NULL ORDER BY coalesce(s.score, 0) DESC, n.published_at DESC NULLS LAST, n.id LIMIT 100""",
)
def _(v: Views) -> DataFrame:
    return lists.pending_queue(tables(v), budget=100).select("id", "institution_id", "institution_name")


@query(
    "report_queue",
    """SELECT n.id, n.report_url, n.overall_grade FROM {inspections_text} n JOIN {institutions} i ON i.id = n.institution_id WHERE n.report_url <> '' AND n.report_text IS NULL
       AND i.type IN ('itp', 'university') ORDER BY CASE n.overall_grade WHEN 'inadequate' THEN 0 WHEN 'requires_improvement' THEN 1 ELSE 2 END, n.inspection_start_date DESC, n.id LIMIT 500""",
)
def _(v: Views) -> DataFrame:
    t = Tables(v.institutions, v.inspections_text)
    return lists.report_queue(t, ["inadequate", "requires_improvement"], 500, ["itp", "university"]).select("id", "report_url", "overall_grade")


@query(
    "provider_queue",
    """SELECT i.id, i.name, s.tier, s.score FROM {institutions} i JOIN {scores} s ON s.institution_id = i.id WHERE i.in_scope AND (i.type IN ('itp', 'fe_college', 'sixth_form_college', 'university')
       OR (s.tier IN ('critical', 'high') AND i.type = 'employer')) ORDER BY CASE s.tier WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'worth_a_look' THEN 2 ELSE 3 END, s.score DESC, i.id LIMIT 80""",
)
def _(v: Views) -> DataFrame:
    return lists.provider_queue(tables(v), 80)


@query("stale_queue", "SELECT id, name, postcode FROM {institutions} WHERE type = 'itp' AND in_scope ORDER BY updated_at, id LIMIT 200")
def _(v: Views) -> DataFrame:
    return lists.stale_queue(v.institutions, 200).drop("updated_at")


@query(
    "enrichment_cohort",
    """SELECT i.id, i.website, s.tier, s.score FROM {institutions} i LEFT JOIN {scores} s ON s.institution_id = i.id WHERE i.in_scope AND i.website IS NOT NULL AND i.general_email IS NULL AND i.head_email IS NULL
       AND s.tier IN ('critical', 'high', 'worth_a_look') ORDER BY s.score DESC, i.id LIMIT 300""",
)
def _(v: Views) -> DataFrame:
    return lists.enrichment_cohort(tables(v), 300, ["critical", "high", "worth_a_look"])


@query(
    "directory_cohort",
    """SELECT id, ukprn, type FROM {institutions} WHERE in_scope AND ukprn IS NOT NULL AND type IN ('itp', 'fe_college', 'sixth_form_college', 'employer')
       AND (general_email IS NULL OR website IS NULL OR coalesce(apprenticeship_standards, 0) = 0) ORDER BY id LIMIT 500""",
)
def _(v: Views) -> DataFrame:
    return lists.directory_cohort(v.institutions, 500)


@query(
    "qa_sample",
    """SELECT i.id AS institution_id, i.name, i.region, i.type, n.inspection_start_date FROM (SELECT institution_id, arg_min(inspection_id, id) AS inspection_id FROM {findings} WHERE NOT suppressed GROUP BY 1
         ORDER BY md5('7:' || CAST(institution_id AS VARCHAR)) LIMIT 10) p JOIN {institutions} i ON i.id = p.institution_id JOIN {inspections} n ON n.id = p.inspection_id""",
)
def _(v: Views) -> DataFrame:
    return lists.qa_sample(tables(v, False), 10, seed=7)


# ---- reports ----------------------------------------------------------------


@query(
    "group_findings",
    f"""SELECT institution_id, curriculum, CAST(count(*) OVER (PARTITION BY institution_id, curriculum) AS BIGINT) AS group_size, id FROM (SELECT *, CASE split_part(phrase_id, '.', 1) WHEN 'fin_lit' THEN 'financial_literacy'
        WHEN 'emp' THEN 'employability_skills' WHEN 'cr' THEN 'confidence_resilience' WHEN 'os' THEN 'online_safety' WHEN 'shared' THEN 'confidence_resilience' ELSE 'other' END AS curriculum FROM {{findings}} WHERE NOT suppressed) x""",
)
def _(v: Views) -> DataFrame:
    return detail.group_findings(v.findings).select("institution_id", "curriculum", "group_size", "id")


@query(
    "weak_without_text",
    """SELECT n.id, i.name, n.overall_grade, n.inspection_start_date FROM {inspections_text} n JOIN {institutions} i ON i.id = n.institution_id WHERE i.type = 'itp' AND n.overall_grade IN ('requires_improvement', 'inadequate')
       AND n.report_text IS NULL AND n.report_url IS NOT NULL ORDER BY n.inspection_start_date DESC, n.id LIMIT 20""",
)
def _(v: Views) -> DataFrame:
    return triggered.weak_without_text(Tables(v.institutions, v.inspections_text), n=20).select("id", "name", "overall_grade", "inspection_start_date")


@query(
    "recent_weak_count",
    f"""SELECT {N} AS recent_weak FROM {{institutions}} i JOIN {{lst}} l ON l.iid = i.id WHERE i.type = 'itp' AND i.in_scope AND l.latest_grade IN ('requires_improvement', 'inadequate') AND l.publication_date >= '{SINCE}'""",
)
def _(v: Views) -> DataFrame:
    return triggered.recent_weak_count(tables(v, False), SINCE)


@query(
    "high_trigger_news",
    """SELECT n.id, n.institution_id, i.name, i.type, n.trigger_severity, n.relevance, left(n.title, 50) AS title, left(n.angle, 80) AS angle FROM {news} n JOIN {institutions} i ON i.id = n.institution_id
       WHERE n.trigger_severity >= 70 AND n.relevance >= 50""",
)
def _(v: Views) -> DataFrame:
    return triggered.high_trigger_news(tables(v, False), title=50, angle=80).drop("source", "published_at")


@query(
    "triggered",
    f"""SELECT i.id, i.name, i.type, s.tier, s.score, s.urgency_score, s.pipeline_value_score, s.top_curriculum,
        (SELECT {N} FROM {{notices}} c WHERE c.institution_id = i.id AND c.withdrawn_at IS NULL) AS compliance_count, (SELECT {N} FROM {{news}} n WHERE n.institution_id = i.id AND n.trigger_severity >= 50) AS news_count
        FROM {{institutions}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.type = 'itp' AND i.in_scope ORDER BY s.urgency_score DESC, s.score DESC, i.id LIMIT 15""",
)
def _(v: Views) -> DataFrame:
    return triggered.triggered(tables(v), n=15)


@query(
    "notice_impact",
    """SELECT i.id, i.name, s.tier, s.score, s.urgency_score, s.pipeline_value_score, c.id AS notice_id FROM {institutions} i JOIN {scores} s ON s.institution_id = i.id
       JOIN {notices} c ON c.institution_id = i.id AND c.withdrawn_at IS NULL WHERE i.type = 'itp' ORDER BY s.urgency_score DESC, i.id, c.id LIMIT 20""",
)
def _(v: Views) -> DataFrame:
    return triggered.notice_impact(tables(v), n=20)


@query("finding_coverage", f"SELECT CAST(count(DISTINCT i.id) AS BIGINT) AS institutions_with_findings, {N} AS total_findings FROM {{findings}} f JOIN {{institutions}} i ON i.id = f.institution_id WHERE i.type = 'itp'")
def _(v: Views) -> DataFrame:
    return triggered.finding_coverage(tables(v, False))


@query("name_search", "SELECT id, name, type FROM {institutions} WHERE lower(name) LIKE '%training%' OR lower(name) LIKE 'the %' OR lower(name) LIKE '%college%'")
def _(v: Views) -> DataFrame:
    return name_search(v.institutions, ["%Training%", "the %", "%COLLEGE%"]).select("id", "name", "type")


@query(
    "name_search_stored",
    "SELECT id, name, type FROM {institutions} WHERE lower(name) LIKE '%training%' OR lower(name) LIKE 'the %' OR lower(name) LIKE '%college%' OR lower(name) LIKE '%_1%2_'",
)
def _(v: Views) -> DataFrame:
    path = scratch_dir(v.spark, "name-index")
    store_name_index(v.institutions, path)
    index = GramIndex.open(v.spark, path)
    few = name_search_stored(index, ["%Training%", "the %", "%COLLEGE%"])
    # a pattern without a run of three characters is tested on all rows
    return few.unionByName(name_search_stored(index, ["%_1%2_"])).select("id", "name", "type").distinct()


@query(
    "outreach_rows",
    f"""SELECT i.id, coalesce(nullif(i.head_email, ''), nullif(i.general_email, '')) AS email, i.name AS company_name, s.top_curriculum, CAST(s.score AS VARCHAR) AS opportunity_score,
        {sql_label('l.latest_grade')} AS latest_grade, l.latest_report_url AS inspection_url, f.phrase_id AS top_weakness
        FROM {{institutions}} i LEFT JOIN {{scores}} s ON s.institution_id = i.id LEFT JOIN {{lst}} l ON l.iid = i.id LEFT JOIN {{findings}} f ON f.id = s.top_finding_id
        WHERE coalesce(nullif(i.head_email, ''), nullif(i.general_email, '')) IS NOT NULL""",
)
def _(v: Views) -> DataFrame:
    rows = outreach.outreach_rows(tables(v))
    keys = ["top_curriculum", "opportunity_score", "latest_grade", "inspection_url", "top_weakness"]
    return rows.select("id", "email", "company_name", *[F.try_element_at("custom_variables", F.lit(k)).alias(k) for k in keys])


@query(
    "email_context",
    """SELECT i.id, coalesce(s.top_curriculum, 'confidence_resilience') AS top_curriculum, l.latest_grade AS current_grade, f.section_key AS source_section, c.subject AS notice_subject, n.title AS news_title
       FROM {institutions} i JOIN {scores} s ON s.institution_id = i.id LEFT JOIN {lst} l ON l.iid = i.id
       LEFT JOIN (SELECT * FROM {findings} WHERE NOT suppressed QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY final_severity DESC, id) = 1) f ON f.institution_id = i.id
       LEFT JOIN (SELECT * FROM {notices} WHERE withdrawn_at IS NULL QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY severity DESC, id) = 1) c ON c.institution_id = i.id
       LEFT JOIN (SELECT * FROM {news} WHERE relevance >= 60 AND trigger_severity >= 60 QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY trigger_severity DESC, published_at DESC NULLS LAST, id) = 1) n ON n.institution_id = i.id""",
)
def _(v: Views) -> DataFrame:
    return outreach.email_context(tables(v)).select("id", "top_curriculum", "current_grade", "source_section", "notice_subject", "news_title")


def _dash(kind: str):
    return lambda v: {
        "provider": lambda: dashboards.provider_dashboard(tables(v), "2002-01-01"),
        "university": lambda: dashboards.university_dashboard(tables(v), SINCE),
    }[kind]()


def _universe_sql(type_: str) -> str:
    return f"""SELECT {N} AS total, {cnt('with_report_url OR with_active_compliance OR with_news_signal')} AS actionable,
      {cnt('general_email IS NOT NULL OR head_email IS NOT NULL')} AS with_email, CAST(coalesce(sum(apprenticeship_standards), 0) AS BIGINT) AS total_standards
      FROM {{evid}} WHERE type = '{type_}' AND in_scope"""


@query("provider_dashboard_universe", _universe_sql("itp"))
def _(v: Views) -> DataFrame:
    return _dash("provider")(v)["universe"]


@query("university_dashboard_universe", _universe_sql("university"))
def _(v: Views) -> DataFrame:
    return _dash("university")(v)["universe"]


_SHORT = "array_to_string(s.critical_signals[1:3], ' · ') AS critical_signals"
_TOP_COLUMNS = ["id", "name", "tier", "score", "critical_signals"]


def _top_sql(source: str, kind: str, where: str, order: str) -> str:
    return f"""SELECT i.id, i.name, s.tier, s.score, {_SHORT} FROM {{{source}}} i {kind} JOIN {{scores}} s ON s.institution_id = i.id LEFT JOIN {{lst}} l ON l.iid = i.id WHERE i.in_scope AND {where} {order}"""


def _feed_sql(type_: str, kind: str, n: int) -> str:
    if kind == "notices":
        return f"""SELECT c.id, c.institution_id, i.name, i.ukprn, c.notice_body, c.notice_type, c.severity, c.subject, c.issued_at, c.source_url FROM {{notices}} c JOIN {{institutions}} i ON i.id = c.institution_id
          WHERE i.type = '{type_}' AND c.withdrawn_at IS NULL ORDER BY c.severity DESC, c.issued_at DESC NULLS LAST, c.id LIMIT {n}"""
    return f"""SELECT c.id, c.institution_id, i.name, i.ukprn, c.title, c.angle, c.trigger_severity, c.relevance, c.curricula_tagged, c.published_at, c.url, c.source FROM {{news}} c JOIN {{institutions}} i ON i.id = c.institution_id
      WHERE i.type = '{type_}' AND c.trigger_severity >= 50 AND c.relevance >= 50 ORDER BY c.trigger_severity DESC, c.published_at DESC NULLS LAST, c.id LIMIT {n}"""


def _flagged_sql(type_: str, since: str) -> str:
    of = f"IN (SELECT id FROM {{institutions}} WHERE type = '{type_}')"
    return f"""SELECT (SELECT count(DISTINCT institution_id) FROM {{notices}} WHERE withdrawn_at IS NULL AND institution_id {of}) AS active_compliance,
      (SELECT count(DISTINCT institution_id) FROM {{inspections}} WHERE publication_date >= '{since}' AND overall_grade IN ('requires_improvement', 'inadequate') AND institution_id {of}) AS recent_weak,
      (SELECT count(DISTINCT institution_id) FROM {{news}} WHERE trigger_severity >= 70 AND relevance >= 60 AND institution_id {of}) AS active_news_trigger"""


def _tiers_sql(type_: str, more: str = "") -> str:
    return f"""SELECT t.tier, CAST(count(x.tier) AS BIGINT) AS n FROM (VALUES ('critical'), ('high'), ('worth_a_look'), ('skip')) t(tier) LEFT JOIN
      (SELECT s.tier FROM {{evid}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.type = '{type_}' AND i.in_scope AND (with_report_url OR with_active_compliance OR with_news_signal{more})) x ON x.tier = t.tier GROUP BY 1"""


_ENOUGH = " OR coalesce(i.apprenticeship_standards >= 5, FALSE)"
_UNI_ALL = f"""SELECT i.id, i.name, s.tier, s.score, {_SHORT} FROM {{evid}} i LEFT JOIN {{scores}} s ON s.institution_id = i.id WHERE i.type = 'university' AND i.in_scope AND (with_report_url OR with_active_compliance OR with_news_signal{_ENOUGH})"""
for _board, _frame, _sql in [
    ("provider", "tiers", _tiers_sql("itp")),
    ("provider", "flagged", _flagged_sql("itp", "2001-01-01")),
    ("provider", "critical", _top_sql("act", "", "i.type = 'itp' AND s.tier = 'critical'", "")),
    ("provider", "high", _top_sql("act", "", "i.type = 'itp' AND s.tier = 'high'", f"ORDER BY {_URGENT} LIMIT 30")),
    ("provider", "outstanding", _top_sql("institutions", "", "i.type = 'itp' AND l.latest_grade = 'outstanding'", "ORDER BY l.latest_inspection_date_ DESC, i.id LIMIT 20")),
    ("provider", "major", _top_sql("act", "", "i.type = 'itp'", f"ORDER BY {_SIZE} LIMIT 25")),
    ("provider", "all", _top_sql("act", "LEFT", "i.type = 'itp'", "")),
    ("provider", "notices", _feed_sql("itp", "notices", 20)),
    ("provider", "news", _feed_sql("itp", "news", 20)),
    ("university", "tiers", _tiers_sql("university", _ENOUGH)),
    ("university", "flagged", _flagged_sql("university", SINCE)),
    ("university", "all", _UNI_ALL),
    ("university", "notices", _feed_sql("university", "notices", 10)),
    ("university", "news", _feed_sql("university", "news", 15)),
]:

    def _board_frame(v: Views, board: str = _board, frame: str = _frame) -> DataFrame:
        df = _dash(board)(v)[frame]
        return joined(df).select(*_TOP_COLUMNS) if "critical_signals" in df.columns else df

    query(f"{_board}_dashboard_{_frame}", _sql)(_board_frame)


# The whole briefs and detail records need the report sections.


def _full_tables(v: Views) -> Tables:
    from .q_texts import sections

    t = tables(v)
    return Tables(t.institutions, t.inspections, sections(v), t.findings, t.matches, t.notices, t.news, t.scores, t.runs)


def _json(*fields: str) -> str:
    """DuckDB: one JSON object of the fields that are not null."""
    parts = ", ".join(f"""CASE WHEN {f} IS NOT NULL THEN '"{f.split('.')[-1]}":' || CAST(to_json({f}) AS VARCHAR) END""" for f in fields)
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') || '}}'"


#: The quoted sections and their widths; fixed values.
_QUOTED = """what_provider_needs_to_improve what_school_needs_to_improve areas_for_action areas_for_improvement recommendations apprenticeships
  adult_learning young_peoples_provision high_needs_provision quality_of_education behaviour_attitudes personal_development
  leadership_management safeguarding main_findings""".split()


def _quotes(main: int) -> str:
    cap = f"CASE WHEN section_key = 'main_findings' THEN {main} ELSE 1800 END"
    return f"""SELECT inspection_id, section_key, order_index, CASE WHEN length(x) > {cap} THEN substr(x, 1, {cap}) || '…' ELSE x END AS quote
      FROM (SELECT *, regexp_replace(section_text, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g') AS x FROM {{t1}}
        WHERE section_key IN ({', '.join(f"'{k}'" for k in _QUOTED)}) QUALIFY row_number() OVER (PARTITION BY inspection_id, section_key ORDER BY order_index) = 1) y WHERE length(x) >= 30"""


_GRADE_BADGE = """CASE WHEN coalesce({g}, '') = '' THEN '—' WHEN {g} = 'outstanding' THEN '🟢 outstanding' WHEN {g} = 'good' THEN '🔵 good' WHEN {g} = 'requires_improvement' THEN '🟠 requires improvement'
  WHEN {g} = 'inadequate' THEN '🔴 inadequate' ELSE {g} END"""
_SECTION_LABEL = """CASE section_key WHEN 'what_provider_needs_to_improve' THEN 'What this provider needs to improve' WHEN 'what_school_needs_to_improve' THEN 'What this school needs to improve'
  WHEN 'areas_for_action' THEN 'Areas for action' WHEN 'areas_for_improvement' THEN 'Areas for improvement' WHEN 'recommendations' THEN 'Recommendations' WHEN 'apprenticeships' THEN 'Apprenticeships'
  WHEN 'adult_learning' THEN 'Adult learning programmes' WHEN 'young_peoples_provision' THEN 'Education programmes for young people' WHEN 'high_needs_provision' THEN 'Provision for learners with high needs'
  WHEN 'quality_of_education' THEN 'Quality of education' WHEN 'behaviour_attitudes' THEN 'Behaviour and attitudes' WHEN 'personal_development' THEN 'Personal development'
  WHEN 'leadership_management' THEN 'Leadership and management' WHEN 'safeguarding' THEN 'Safeguarding' ELSE 'What is it like to be a learner here / What does the provider do well' END"""
_HISTORY_FIELDS = [
    ("Apprenticeships", "apprenticeships"), ("Adult learning programmes", "adult_learning_programmes"), ("Education programmes for young people", "young_peoples_provision"),
    ("Provision for learners with high needs", "high_needs_provision"), ("Contribution to meeting skills needs", "contribution_to_skills"), ("Quality of education", "quality_of_education"),
    ("Behaviour and attitudes", "behaviour_attitudes"), ("Personal development", "personal_development"), ("Leadership and management", "leadership_management"),
]
_NL = "chr(10)"


def _opt(label: str, column: str, tail: str = "") -> str:
    return f"CASE WHEN coalesce(CAST({column} AS VARCHAR), '') <> '' THEN '{label}' || {column} || '{tail}' END"


def _brief_sql(tiers: list[str], types: list[str], as_of: str) -> str:
    """(institution_id, file_name, block, place, item_id, text) of all lines of all briefs."""
    known = "FROM bc c LEFT JOIN"
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    subs = ", ".join(
        f"'- {label}: ' || CAST({c}_score AS VARCHAR)"
        for c, label in (("financial_literacy", "Financial Literacy"), ("employability_skills", "Employability Skills"), ("confidence_resilience", "Confidence & Resilience"), ("online_safety", "Online Safety"))
    )
    head = f"""concat_ws({_NL}, '# ' || name, '', '**' || CASE tier WHEN 'critical' THEN '🔴 CRITICAL' WHEN 'high' THEN '🟠 HIGH' WHEN 'worth_a_look' THEN '🟡 worth a look' ELSE tier END || '** · score **' || score
        || '** · urgency ' || urgency_score || ' · pipeline ' || pipeline_value_score, {_NL} || '## Identity' || {_NL},
      '- **Type**: ' || type || CASE WHEN coalesce(apprenticeship_standards, 0) > 0 THEN ' · ' || apprenticeship_standards || ' apprenticeship standards' ELSE '' END,
      {_opt('- **UKPRN**: ', 'ukprn')}, {_opt('- **URN**: ', 'urn')},
      '- **Location**: ' || nullif(concat_ws(', ', nullif(postcode, ''), nullif(local_authority, ''), nullif(region, '')), ''),
      {_opt('- **Website**: ', 'website')}, {_opt('- **Email**: ', 'general_email')}, {_opt('- **Lead contact**: ', 'head_name')}, {_NL} || '## Lead-with curriculum' || {_NL},
      CASE WHEN top_curriculum IS NOT NULL THEN concat_ws({_NL}, '**' || CASE top_curriculum WHEN 'financial_literacy' THEN 'Financial Literacy' WHEN 'employability_skills' THEN 'Employability Skills'
          WHEN 'confidence_resilience' THEN 'Confidence & Resilience' WHEN 'online_safety' THEN 'Online Safety' END || '** (sub-score ' || top_curriculum_score || ')', '', {subs})
        ELSE '_No curriculum recommendation yet (no inspection signal)._' END,
      {_NL} || '## Why this is on the list' || {_NL},
      CASE WHEN len(list_filter(critical_signals, lambda s: trim(s) <> '')) > 0 THEN array_to_string(list_transform(list_filter(critical_signals, lambda s: trim(s) <> ''), lambda s: '- ' || s), {_NL}) ELSE '_No signals recorded._' END,
      {_NL} || '## Ofsted history' || {_NL})"""
    history = f"""concat_ws({_NL}, '### ' || {_GRADE_BADGE.format(g='overall_grade')} || ' · ' || inspection_start_date || CASE WHEN coalesce(previous_overall_grade, '') <> '' THEN ' (was: ' || previous_overall_grade
        || CASE WHEN grade_dropped THEN ' — dropped' ELSE '' END || ')' ELSE '' END, '', {', '.join(_opt(f'- {label}: **', c, '**') for label, c in _HISTORY_FIELDS)},
      CASE WHEN safeguarding_effective THEN '- Safeguarding: Met' WHEN NOT safeguarding_effective THEN '- Safeguarding: **NOT MET**' END, {_opt('- [Report](', 'report_url', ')')}, '')"""
    order = "CASE section_key " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(_QUOTED)) + " END"
    return f"""WITH bc AS (SELECT i.*, s.* EXCLUDE (institution_id), i.id AS institution_id FROM {{institutions}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.in_scope AND s.tier IN ({listed(tiers)}) AND i.type IN ({listed(types)})),
      bi AS (SELECT n.*, row_number() OVER (PARTITION BY n.institution_id ORDER BY n.inspection_start_date DESC, n.id) AS rn, count(*) OVER (PARTITION BY n.institution_id) AS n FROM {{inspections}} n JOIN bc ON bc.id = n.institution_id),
      bl AS (SELECT n.* FROM bi n WHERE EXISTS (SELECT 1 FROM {{t1}} s WHERE s.inspection_id = n.id) QUALIFY row_number() OVER (PARTITION BY n.institution_id ORDER BY n.inspection_start_date DESC, n.id) = 1),
      bn AS (SELECT n.*, row_number() OVER (PARTITION BY n.institution_id, n.withdrawn_at IS NULL ORDER BY n.severity DESC, n.id) AS rn FROM {{notices}} n JOIN bc ON bc.id = n.institution_id),
      bk AS (SELECT institution_id, count(*) FILTER (withdrawn_at IS NULL) AS n_open, count(*) FILTER (withdrawn_at IS NOT NULL) AS n_closed FROM bn GROUP BY 1),
      bw AS (SELECT n.*, row_number() OVER (PARTITION BY n.institution_id ORDER BY n.trigger_severity DESC, n.published_at DESC NULLS LAST, n.id) AS rn FROM {{news}} n JOIN bc ON bc.id = n.institution_id
        WHERE n.relevance >= 50 AND (n.trigger_severity > 0 OR n.angle IS NULL) QUALIFY rn <= 8),
      bm AS (SELECT institution_id, count(*) AS n, count(*) FILTER (trigger_severity >= 40) AS strong FROM bw GROUP BY 1),
      bf AS (SELECT n.*, row_number() OVER (PARTITION BY n.institution_id ORDER BY n.final_severity DESC, n.id) AS rn FROM {{findings}} n JOIN bc ON bc.id = n.institution_id WHERE NOT n.suppressed),
      bq AS ({_quotes(2400)}),
      lines AS (
        SELECT institution_id, 0 AS block, 0.0 AS place, 0 AS item_id, {head} AS text FROM bc
        UNION ALL SELECT institution_id, 1, rn, id, {history} FROM bi WHERE rn <= 3
        UNION ALL SELECT c.institution_id, 2, 0, 0, CASE WHEN x.n IS NULL THEN '_No inspection records on file._' ELSE '_+ ' || (x.n - 3) || CASE WHEN x.n = 4 THEN ' earlier inspection' ELSE ' earlier inspections' END || ' in the database._' || {_NL} END
          {known} (SELECT institution_id, any_value(n) AS n FROM bi GROUP BY 1) x ON x.institution_id = c.institution_id WHERE x.n IS NULL OR x.n > 3
        UNION ALL SELECT l.institution_id, 3, 0, 0, concat_ws({_NL}, {_NL} || '## Verbatim from the latest inspection report' || {_NL}, 'Inspection of ' || c.name || ' · ' || l.inspection_start_date || ' · grade: **' || {_GRADE_BADGE.format(g='l.overall_grade')} || '**.',
            {_opt('[Full report](', 'l.report_url', ')')}, '', 'Direct quotes from the report. Use these in outreach without paraphrasing — they''re exactly what the inspector wrote.' || {_NL})
          FROM bl l JOIN bc c ON c.institution_id = l.institution_id WHERE EXISTS (SELECT 1 FROM {{t1}} s WHERE s.inspection_id = l.id AND s.section_key IN ({listed(_QUOTED)}))
        UNION ALL SELECT l.institution_id, 4, {order}, q.inspection_id, concat_ws({_NL}, '### ' || {_SECTION_LABEL}, '',
            array_to_string(list_transform(string_split_regex(q.quote, '\r?\n'), lambda x: CASE WHEN regexp_replace(x, '^[\\s ]+|[\\s ]+$', '', 'g') = '' THEN '>' ELSE '> ' || regexp_replace(x, '^[\\s ]+|[\\s ]+$', '', 'g') END), {_NL}), '')
          FROM bq q JOIN bl l ON l.id = q.inspection_id
        UNION ALL SELECT c.institution_id, 5, 0, 0, {_NL} || '## Compliance signals' || {_NL} || CASE WHEN k.n_open IS NULL THEN {_NL} || '_No public regulatory or financial-health notices on file._' || {_NL} WHEN k.n_open > 0 THEN {_NL} || '### Active' || {_NL} ELSE '' END
          {known} bk k ON k.institution_id = c.institution_id
        UNION ALL SELECT institution_id, 6, -severity, id, concat_ws({_NL}, '- **' || subject || '** · severity ' || severity, '  ' || notice_body || ' · ' || notice_type || coalesce(' · issued ' || nullif(issued_at, ''), ''),
            CASE WHEN coalesce(details, '') <> '' THEN '  > ' || substr(details, 1, 240) END, {_opt('  [Source](', 'source_url', ')')}, '') FROM bn WHERE withdrawn_at IS NULL
        UNION ALL SELECT institution_id, 7, 0, 0, '### Historical (withdrawn / closed)' || {_NL} FROM bk WHERE n_closed > 0
        UNION ALL SELECT institution_id, 8, rn, id, '- ' || subject || ' (closed ' || withdrawn_at || ')' FROM bn WHERE withdrawn_at IS NOT NULL AND rn <= 4
        UNION ALL SELECT institution_id, 9, 0, 0, '- _+ ' || (n_closed - 4) || ' more_' FROM bk WHERE n_closed > 4
        UNION ALL SELECT c.institution_id, 10, 0, 0, {_NL} || '## News signals' || {_NL} || CASE WHEN coalesce(m.strong, 0) = 0 THEN concat_ws({_NL}, {_NL} || '_No high-trigger news matched in the last extraction pass._',
            CASE WHEN coalesce(m.n, 0) > 0 THEN '_(' || m.n || ' low-signal items in DB.)_' END, '') ELSE '' END {known} bm m ON m.institution_id = c.institution_id
        UNION ALL SELECT institution_id, 11, rn, id, concat_ws({_NL}, '- **' || title || '** · severity ' || trigger_severity || ' · relevance ' || relevance,
            '  ' || source || coalesce(' · ' || nullif(published_at, ''), '') || coalesce(' · curricula: ' || nullif(curricula_tagged, ''), ''), CASE WHEN coalesce(angle, '') NOT IN ('', 'no angle') THEN '  > ' || angle END,
            {_opt('  [Read](', 'url', ')')}, '') FROM bw WHERE trigger_severity >= 40
        UNION ALL SELECT DISTINCT institution_id, 12, 0, 0, {_NL} || '## Verbatim inspection findings' || {_NL} || {_NL} || 'Quotes you can drop directly into outreach. Severity drives the score.' || {_NL} FROM bf
        UNION ALL SELECT institution_id, 13, rn, id, concat_ws({_NL}, '- **' || phrase_id || '** (severity ' || CAST(CAST(CAST(final_severity AS DECIMAL(18, 6)) AS DECIMAL(18, 1)) AS VARCHAR) || ', ' || section_key || ')',
            '  > ' || substr(replace(source_quote, {_NL}, ' '), 1, 360), '') FROM bf WHERE rn <= 6
        UNION ALL SELECT institution_id, 14, 0, 0, '---' || {_NL} || {_NL} || '_Generated · {as_of}_' FROM bc)
      SELECT l.institution_id, coalesce(nullif(c.ukprn, ''), 'id' || c.id) || '-' || left(regexp_replace(regexp_replace(lower(c.name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) || '.md' AS file_name,
        CAST(l.block AS INT) AS block, CAST(l.place AS DOUBLE) AS place, CAST(l.item_id AS BIGINT) AS item_id, l.text FROM lines l JOIN bc c ON c.institution_id = l.institution_id"""


_BRIEF_TYPES = ["itp", "fe_college", "university"]


@query("briefs", _brief_sql(["critical", "high"], _BRIEF_TYPES, "2003-03-31"))
def _(v: Views) -> DataFrame:
    return briefs.briefs(_full_tables(v), ["critical", "high"], _BRIEF_TYPES, "2003-03-31")


@query(
    "brief_cohort_blocks",
    f"""WITH c AS (SELECT i.id FROM {{institutions}} i JOIN {{scores}} s ON s.institution_id = i.id WHERE i.in_scope AND s.tier IN ('critical', 'high') AND i.type IN ('itp', 'fe_college', 'university'))
        SELECT block, CAST(count(*) AS BIGINT) AS n FROM (SELECT 0 AS block FROM c UNION ALL SELECT 14 FROM c UNION ALL SELECT 5 FROM c UNION ALL SELECT 10 FROM c
          UNION ALL SELECT 6 FROM c JOIN {{notices}} n ON n.institution_id = c.id AND n.withdrawn_at IS NULL
          UNION ALL SELECT 1 FROM (SELECT row_number() OVER (PARTITION BY c.id ORDER BY n.inspection_start_date) AS rn FROM c JOIN {{inspections}} n ON n.institution_id = c.id) x WHERE rn <= 3) y GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    lines = briefs.briefs(_full_tables(v), ["critical", "high"], ["itp", "fe_college", "university"], "2003-03-31")
    return lines.where(F.col("block").isin(0, 1, 5, 6, 10, 14)).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query("section_quotes", _quotes(2400))
def _(v: Views) -> DataFrame:
    from .q_texts import sections

    return detail.section_quotes(sections(v), main_findings_cap=2400, cap=1800)


@query(
    "detail_records",
    f"""SELECT institution_id, 'inspection' AS kind, CAST(NULL AS DOUBLE) AS rank_number, inspection_start_date AS rank_text, id AS item_id,
          {_json('inspection_body', 'overall_grade', 'previous_overall_grade', 'grade_dropped', 'report_url')} AS payload FROM {{inspections}}
        UNION ALL SELECT institution_id, 'finding', CAST(final_severity AS DOUBLE), NULL, id, {_json('phrase_id', 'section_key', 'source_quote', 'suppressed')} FROM {{findings}}
        UNION ALL SELECT institution_id, 'notice', CAST(severity AS DOUBLE), issued_at, id, {_json('notice_body', 'notice_type', 'subject', 'withdrawn_at', 'source_url')} FROM {{notices}}
        UNION ALL SELECT institution_id, 'news', CAST(trigger_severity AS DOUBLE), published_at, id, {_json('title', 'url', 'relevance', 'angle')} FROM {{news}}
        UNION ALL SELECT l.institution_id, 'section', CAST(-q.order_index AS DOUBLE), NULL, q.inspection_id, {_json('q.section_key', 'q.quote')} FROM ({_quotes(1800)}) q
          JOIN (SELECT n.id, n.institution_id FROM {{inspections}} n WHERE EXISTS (SELECT 1 FROM {{t1}} s WHERE s.inspection_id = n.id)
            QUALIFY row_number() OVER (PARTITION BY n.institution_id ORDER BY n.inspection_start_date DESC, n.id) = 1) l ON l.id = q.inspection_id""",
)
def _(v: Views) -> DataFrame:
    return detail.detail_records(_full_tables(v), quote_cap=1800)

"""Evidence bags and the scoring steps, each checked at its own stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators import bags
from tierline.operators import scoring as sc
from tierline.schemas import CURRICULA
from tierline.session import cut_lineage

from . import expected
from .registry import SHARED, query
from .views import AS_OF, Views

_SHORT = dict(zip(CURRICULA, ("fl", "es", "cr", "os")))


def _per(template: str) -> str:
    """``template`` repeated per curriculum ({c} name, {s} short name)."""
    return ", ".join(template.replace("<c>", c).replace("<s>", s) for c, s in _SHORT.items())


_FOCUS = """CASE f.section_key WHEN 'safeguarding' THEN 1.6 WHEN 'personal_development' THEN 1.5 WHEN 'behaviour_attitudes' THEN 1.3
  WHEN 'what_school_needs_to_improve' THEN 1.0 WHEN 'what_provider_needs_to_improve' THEN 1.0 WHEN 'areas_for_action' THEN 1.0
  WHEN 'recommendations' THEN 1.0 WHEN 'areas_for_improvement' THEN 1.0 WHEN 'main_findings' THEN 0.7 WHEN 'summary' THEN 0.3
  WHEN 'significant_strengths' THEN 0.0 WHEN 'strengths' THEN 0.0 ELSE 0.5 END"""
_RANK = """CASE overall_grade WHEN 'outstanding' THEN 1 WHEN 'good' THEN 2 WHEN 'meets_standard' THEN 2 WHEN 'requires_improvement' THEN 3
  WHEN 'inadequate' THEN 4 WHEN 'does_not_meet_standard' THEN 4 ELSE 99 END"""

SHARED["sc_latest"] = """SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY institution_id ORDER BY inspection_start_date DESC, id) AS rn
  FROM {inspections} n) x WHERE rn = 1"""
SHARED["sc_meta"] = f"""SELECT institution_id, CAST(count(*) AS BIGINT) AS inspection_count, min(inspection_start_date) AS first_inspection_date,
  max(inspection_start_date) AS latest_inspection_date, arg_min(overall_grade, {_RANK} * 100000000000 + id) AS best_grade
  FROM {{inspections}} GROUP BY institution_id"""
SHARED["sc_fbag"] = f"""SELECT institution_id, {_per("sum(CASE WHEN curriculum = '<c>' THEN w ELSE 0 END) AS <c>_total")},
  CAST(count(DISTINCT id) AS BIGINT) AS finding_count, arg_min(CASE WHEN w > 0 THEN id END, CASE WHEN w > 0 THEN rn END) AS top_finding_id
  FROM (SELECT f.id, f.institution_id, m.curriculum, CAST(f.final_severity * {_FOCUS} AS DOUBLE) AS w,
          row_number() OVER (PARTITION BY f.institution_id ORDER BY f.final_severity * {_FOCUS} DESC, f.id) AS rn
        FROM {{findings}} f JOIN {{matches}} m ON m.finding_id = f.id WHERE NOT f.suppressed) x GROUP BY institution_id"""
SHARED["sc_nbag"] = """SELECT institution_id, list(subject ORDER BY rn) FILTER (WHERE rn <= 3) AS subjects, CAST(count(*) AS BIGINT) AS notice_count,
  max(severity) AS worst_severity
  FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY severity DESC, id) AS rn FROM {notices} WHERE withdrawn_at IS NULL) x
  GROUP BY institution_id"""
SHARED["sc_wbag"] = """SELECT institution_id,
  max(CASE WHEN rn = 1 THEN trigger_severity END) AS sev1, max(CASE WHEN rn = 1 THEN coalesce(angle, left(title, 100)) END) AS head1,
  max(CASE WHEN rn = 1 THEN published_at END) AS pub1, max(CASE WHEN rn = 1 THEN coalesce(curricula_tagged, '') END) AS tags1,
  max(CASE WHEN rn = 2 THEN trigger_severity END) AS sev2, max(CASE WHEN rn = 2 THEN coalesce(angle, left(title, 90)) END) AS head2, max(CASE WHEN rn = 2 THEN published_at END) AS pub2,
  max(CASE WHEN rn = 3 THEN trigger_severity END) AS sev3, max(CASE WHEN rn = 3 THEN coalesce(angle, left(title, 90)) END) AS head3, max(CASE WHEN rn = 3 THEN published_at END) AS pub3
  FROM (SELECT *, row_number() OVER (PARTITION BY institution_id ORDER BY trigger_severity DESC, id) AS rn FROM {news}
        WHERE trigger_severity >= 70 OR relevance >= 60) x GROUP BY institution_id"""
_FIELDS = [f for f in sc.LATEST if f != "id"]
SHARED["sc_base"] = f"""SELECT i.id AS institution_id, i.type, i.in_scope, i.website, i.general_email, i.head_email, i.source, i.apprenticeship_standards,
  m.inspection_count, m.first_inspection_date, m.latest_inspection_date, m.best_grade, l.id AS last_inspection_id, {', '.join('l.' + f for f in _FIELDS)},
  {_per('b.<c>_total')}, b.finding_count, b.top_finding_id, n.subjects, n.notice_count, n.worst_severity,
  w.sev1, w.head1, w.pub1, w.tags1, w.sev2, w.head2, w.pub2, w.sev3, w.head3, w.pub3
  FROM {{institutions}} i LEFT JOIN {{sc_meta}} m ON m.institution_id = i.id LEFT JOIN {{sc_latest}} l ON l.institution_id = i.id
  LEFT JOIN {{sc_fbag}} b ON b.institution_id = i.id LEFT JOIN {{sc_nbag}} n ON n.institution_id = i.id LEFT JOIN {{sc_wbag}} w ON w.institution_id = i.id"""


def _u(field: str) -> str:
    if field == "safeguarding_effective":
        return "CASE WHEN safeguarding_effective THEN -0.05 WHEN NOT safeguarding_effective THEN 1.0 ELSE 0.0 END"
    return (
        f"CASE {field} WHEN 'inadequate' THEN 1.0 WHEN 'does_not_meet_standard' THEN 1.0 WHEN 'requires_improvement' THEN 0.72 "
        f"WHEN 'good' THEN -0.1 WHEN 'outstanding' THEN -0.3 ELSE 0.0 END"
    )


def _d(field: str) -> str:
    if field == "safeguarding_effective":
        return "CASE WHEN safeguarding_effective THEN 'Met' ELSE 'Not met' END"
    return (
        f"CASE {field} WHEN 'inadequate' THEN 'Inadequate' WHEN 'does_not_meet_standard' THEN 'Not met' "
        f"WHEN 'requires_improvement' THEN 'Requires improvement' END"
    )


_FRAME = "CASE WHEN inspection_body = 'isi' THEN 'isi' WHEN type IN ('itp', 'fe_college', 'sixth_form_college') THEN 'fe_skills' ELSE 'school' END"


def _judgement(i: int) -> str:
    arms = []
    for fw, fields in expected.JUDGEMENT_WEIGHTS.items():
        terms = " + ".join(
            f"greatest(CAST({_u(f)} AS DOUBLE), CAST(0 AS DOUBLE)) * CAST({w[i]} AS DOUBLE) * 35" for f, _, w in fields
        )
        arms.append(f"WHEN '{fw}' THEN {terms}")
    return f"least(CAST(70 AS DOUBLE), CASE {_FRAME} {' '.join(arms)} END)"


SHARED["sc_parts"] = f"""SELECT *, {', '.join(f'{_judgement(i)} AS {c}_judgement' for i, c in enumerate(CURRICULA))},
  {_per("CASE WHEN <c>_total > 0 THEN least(CAST(55 AS DOUBLE), sqrt(<c>_total / 25) * 55) ELSE CAST(0 AS DOUBLE) END AS <c>_finding")}
  FROM {{sc_base}} WHERE in_scope AND last_inspection_id IS NOT NULL"""
SHARED["sc_sub"] = f"""SELECT *, {_per("CAST(floor(least(CAST(100 AS DOUBLE), <c>_judgement + <c>_finding) + 0.5) AS INT) AS <s>0")} FROM {{sc_parts}}"""


def _fires(field: str, value) -> str:
    return f"coalesce(NOT {field}, FALSE)" if value is False else f"coalesce({field} = '{value}', FALSE)"


def _floors(c: str) -> str:
    arms = [f"CASE WHEN {_fires(f, v)} THEN {fl[c]} ELSE 0 END" for f, v, fl, _, _ in expected.HARD_FLOORS if c in fl]
    return f"greatest({_SHORT[c]}0, {', '.join(arms)})"


SHARED["sc_floor"] = f"""SELECT *, {', '.join(f'{_floors(c)} AS {s}1' for c, s in _SHORT.items())},
  list_filter([{', '.join(f"CASE WHEN {_fires(f, v)} THEN '{t}' END" for f, v, _, t, _ in expected.HARD_FLOORS)}], lambda x: x IS NOT NULL) AS sig1,
  {' + '.join(f'CAST({_fires(f, v)} AS INT)' for f, v, _, _, k in expected.HARD_FLOORS if k)} AS crit1 FROM {{sc_sub}}"""


def _notes() -> str:
    arms = []
    for fw, fields in expected.JUDGEMENT_WEIGHTS.items():
        notes = ", ".join(f"CASE WHEN {_u(f)} >= 0.7 THEN '{label}: ' || {_d(f)} END" for f, label, _ in fields)
        arms.append(f"WHEN '{fw}' THEN [{notes}]")
    return f"CASE {_FRAME} {' '.join(arms)} END"


SHARED["sc_explained"] = f"""SELECT *, list_concat(sig1, list_filter({_notes()}, lambda x: x IS NOT NULL AND NOT list_contains(sig1, x))) AS sig2 FROM {{sc_floor}}"""
_NFLOOR = "coalesce(CAST(floor(worst_severity * CAST(0.85 AS DOUBLE) + 0.5) AS INT), 0)"
SHARED["sc_noticed"] = f"""SELECT *, {_per(f"greatest(<s>1, {_NFLOOR}) AS <s>2")},
  list_concat(sig2, coalesce(list_transform(subjects, lambda x: 'Compliance: ' || x), [])) AS sig3,
  crit1 + CASE WHEN worst_severity >= 90 THEN 1 ELSE 0 END AS crit2 FROM {{sc_explained}}"""
_TAGLIST = "list_filter(list_transform(string_split(coalesce(tags1, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


def _lift(c: str) -> str:
    return (
        f"CASE WHEN sev1 >= 70 AND len({_TAGLIST}) = 0 THEN CAST(floor(sev1 * CAST(0.65 AS DOUBLE) + 0.5) AS INT) "
        f"WHEN sev1 >= 70 AND list_contains({_TAGLIST}, '{c}') THEN CAST(floor(sev1 * CAST(0.9 AS DOUBLE) + 0.5) AS INT) ELSE 0 END"
    )


SHARED["sc_boosted"] = f"""SELECT *, {', '.join(f'greatest({s}2, {_lift(c)}) AS {s}3' for c, s in _SHORT.items())},
  list_concat(sig3, list_filter([CASE WHEN sev1 >= 70 THEN 'News: ' || head1 || ' (' || coalesce(pub1, 'recent') || ')' END,
    CASE WHEN sev2 >= 50 THEN 'News: ' || head2 || ' (' || coalesce(pub2, 'recent') || ')' END,
    CASE WHEN sev3 >= 50 THEN 'News: ' || head3 || ' (' || coalesce(pub3, 'recent') || ')' END], lambda x: x IS NOT NULL)) AS sig4,
  crit2 + CASE WHEN sev1 >= 85 THEN 1 ELSE 0 END AS crit3 FROM {{sc_noticed}}"""
SHARED["sc_synergy"] = f"""SELECT *, {_per("CASE WHEN crit3 >= 2 THEN least(100, CAST(floor(<s>3 * CAST(1.2 AS DOUBLE) + 0.5) AS INT)) ELSE <s>3 END AS <s>4")},
  CASE WHEN crit3 >= 2 THEN list_append(sig4, '(' || CAST(crit3 AS VARCHAR) || ' critical flags — synergy ×1.2)') ELSE sig4 END AS sig5 FROM {{sc_boosted}}"""


def _lead(suffix: str) -> str:
    best = f"greatest(fl{suffix}, es{suffix}, cr{suffix}, os{suffix})"
    return (
        f"CASE WHEN {best} <= 0 THEN NULL WHEN fl{suffix} = {best} THEN 'financial_literacy' WHEN es{suffix} = {best} "
        f"THEN 'employability_skills' WHEN cr{suffix} = {best} THEN 'confidence_resilience' ELSE 'online_safety' END"
    )


SHARED["sc_led"] = f"SELECT *, {_lead('4')} AS lead, greatest(fl4, es4, cr4, os4, 0) AS urgency FROM {{sc_synergy}}"

_MONTHS = f"(date_diff('day', CAST(latest_inspection_date AS DATE), DATE '{AS_OF}') / CAST(30.44 AS DOUBLE))"
_YEARS = f"(date_diff('day', CAST(first_inspection_date AS DATE), DATE '{AS_OF}') / CAST(365.25 AS DOUBLE))"
_CNT, _STD = "coalesce(inspection_count, 0)", "coalesce(apprenticeship_standards, 0)"
_ELIGIBLE = "type IN ('itp', 'fe_college', 'sixth_form_college', 'university', 'employer')"
_PV = f"""CASE WHEN {_ELIGIBLE} THEN least(100, 35 + CASE WHEN source LIKE '%apar%' THEN 18 ELSE 0 END
  + CASE WHEN {_CNT} >= 5 THEN 18 WHEN {_CNT} >= 3 THEN 14 WHEN {_CNT} >= 1 THEN 8 ELSE 0 END
  + CASE WHEN {_MONTHS} <= 24 THEN 12 WHEN {_MONTHS} <= 60 THEN 6 ELSE 0 END
  + CASE WHEN {_YEARS} >= 15 THEN 12 WHEN {_YEARS} >= 10 THEN 8 WHEN {_YEARS} >= 5 THEN 5 ELSE 0 END
  + CASE best_grade WHEN 'outstanding' THEN 8 WHEN 'good' THEN 5 ELSE 0 END
  + CASE WHEN general_email <> '' OR head_email <> '' THEN 15 ELSE 0 END + CASE WHEN website <> '' THEN 8 ELSE 0 END
  + CASE WHEN {_STD} >= 50 THEN 28 WHEN {_STD} >= 25 THEN 20 WHEN {_STD} >= 10 THEN 12 WHEN {_STD} >= 3 THEN 5 ELSE 0 END) ELSE 0 END"""
_PSIG = f"""CASE WHEN {_ELIGIBLE} THEN list_filter([CASE WHEN source LIKE '%apar%' THEN 'APAR-listed approved provider' END,
  CASE WHEN {_CNT} >= 5 THEN CAST({_CNT} AS VARCHAR) || '+ historical inspections (very established)'
    WHEN {_CNT} >= 3 THEN CAST({_CNT} AS VARCHAR) || '+ historical inspections (established)' WHEN {_CNT} >= 1 THEN 'Has Ofsted track record' END,
  CASE WHEN {_MONTHS} <= 24 THEN 'Active (inspected within 24 months)' WHEN {_MONTHS} <= 60 THEN 'Inspected within 5 years' END,
  CASE WHEN {_YEARS} >= 10 THEN CAST(CAST(floor({_YEARS}) AS INT) AS VARCHAR) || '+ years on Ofsted register' END,
  CASE best_grade WHEN 'outstanding' THEN 'Previously rated Outstanding' WHEN 'good' THEN 'Previously rated Good' END,
  CASE WHEN general_email <> '' OR head_email <> '' THEN 'Reachable (email on file)' END, CASE WHEN website <> '' THEN 'Website on file' END,
  CASE WHEN {_STD} >= 50 THEN CAST({_STD} AS VARCHAR) || ' apprenticeship standards delivered (major provider)'
    WHEN {_STD} >= 25 THEN CAST({_STD} AS VARCHAR) || ' apprenticeship standards delivered (large provider)'
    WHEN {_STD} >= 3 THEN CAST({_STD} AS VARCHAR) || ' apprenticeship standards delivered' END], lambda x: x IS NOT NULL) ELSE [] END"""


def _tier(u: str, p: str) -> str:
    return f"CASE WHEN {u} >= 70 THEN 'critical' WHEN {u} >= 50 THEN 'high' WHEN {p} >= 92 AND {u} >= 30 THEN 'high' WHEN {p} >= 60 OR {u} >= 30 THEN 'worth_a_look' ELSE 'skip' END"


_CEIL = "CASE overall_grade WHEN 'inadequate' THEN 100 WHEN 'does_not_meet_standard' THEN 100 WHEN 'requires_improvement' THEN 95 WHEN 'good' THEN 75 WHEN 'meets_standard' THEN 75 WHEN 'outstanding' THEN 60 ELSE 80 END"
SHARED["sc_inspected"] = f"""SELECT * FROM (SELECT institution_id, CAST(least(greatest({_CEIL}, urgency), greatest(urgency, pv)) AS INT) AS score, CAST(urgency AS INT) AS urgency_score,
  CAST(pv AS INT) AS pipeline_value_score, CAST(fl4 + es4 + cr4 + os4 AS INT) AS raw_score, {_per('<s>4 AS <c>_score')},
  CASE WHEN pv > urgency THEN coalesce(lead, 'employability_skills') ELSE lead END AS top_curriculum, CAST(urgency AS INT) AS top_curriculum_score,
  top_finding_id, CASE WHEN pv > urgency THEN list_concat(sig5, list_transform(ps, lambda x: 'Pipeline: ' || x)) ELSE sig5 END AS critical_signals,
  {_tier('urgency', 'pv')} AS tier, coalesce(finding_count, 0) AS finding_count, inspection_count, first_inspection_date, latest_inspection_date, last_inspection_id
  FROM (SELECT *, {_PV} AS pv, {_PSIG} AS ps FROM {{sc_led}}) x) y WHERE score >= 1 OR len(critical_signals) > 0"""
_NU = "CASE WHEN sev1 >= 70 THEN CAST(floor(sev1 * CAST(0.9 AS DOUBLE) + 0.5) AS INT) ELSE 0 END"
SHARED["sc_uninspected"] = f"""SELECT institution_id, CAST(least(greatest(80, u), greatest(u, pv)) AS INT) AS score, CAST(u AS INT) AS urgency_score, CAST(pv AS INT) AS pipeline_value_score,
  CAST(0 AS INT) AS raw_score, fl5 AS financial_literacy_score, CAST(greatest(es5, pv) AS INT) AS employability_skills_score, cr5 AS confidence_resilience_score, os5 AS online_safety_score,
  coalesce({_lead('5')}, 'employability_skills') AS top_curriculum, CAST(greatest(fl5, es5, cr5, os5, pv) AS INT) AS top_curriculum_score, CAST(NULL AS BIGINT) AS top_finding_id,
  list_concat(CASE WHEN len(aux) > 0 THEN aux ELSE ['Pipeline value (no inspection signal)'] END, list_transform(ps, lambda x: 'Pipeline: ' || x)) AS critical_signals,
  {_tier('u', 'pv')} AS tier, CAST(0 AS BIGINT) AS finding_count, coalesce(inspection_count, 0) AS inspection_count, first_inspection_date, latest_inspection_date, CAST(NULL AS BIGINT) AS last_inspection_id
  FROM (SELECT *, {_PV} AS pv, {_PSIG} AS ps, greatest({_NFLOOR}, {_NU}) AS u, {', '.join(f'greatest({_NFLOOR}, {_lift(c)}) AS {s}5' for c, s in _SHORT.items())},
    list_concat(coalesce(list_transform(subjects, lambda x: 'Compliance: ' || x), []), CASE WHEN sev1 >= 70 THEN ['News: ' || head1] ELSE [] END) AS aux
    FROM {{sc_base}} WHERE in_scope AND last_inspection_id IS NULL AND type IN ('itp', 'fe_college', 'sixth_form_college', 'university')) x WHERE pv >= 1"""
SHARED["sc_employers"] = """SELECT id AS institution_id, boot, CASE WHEN boot THEN 70 ELSE 45 END AS fl, CASE WHEN boot THEN 95 ELSE 78 END AS es,
  CASE WHEN boot THEN 80 ELSE 55 END AS cr, CASE WHEN boot THEN 60 ELSE 40 END AS os,
  list_concat(CASE WHEN boot THEN ['Skills Bootcamps commissioning authority — direct budget for pre-employment programmes', 'Published skills-team contact email on record']
    ELSE ['APAR Employer-Provider — runs own apprenticeship scheme', 'ICP fit: pre-employment bootcamp drops into their existing trainee pipeline'] END,
    CASE WHEN coalesce(website, '') = '' THEN ['(no website on record — enrich first)'] ELSE [] END) AS sig
  FROM (SELECT *, coalesce(source = 'skills_bootcamps', FALSE) AS boot FROM {institutions} WHERE type = 'employer' AND in_scope) x"""
_KEPT = ["urgency_score", "pipeline_value_score", "finding_count", "inspection_count"]
SHARED["scores"] = f"""SELECT coalesce(p.institution_id, e.institution_id) AS institution_id, CAST(coalesce(e.es, p.score) AS INT) AS score,
  {', '.join(f'coalesce(p.{c}, 0) AS {c}' for c in _KEPT)}, CAST(CASE WHEN p.institution_id IS NULL THEN e.fl + e.es + e.cr + e.os ELSE p.raw_score END AS INT) AS raw_score,
  CAST(coalesce(e.fl, p.financial_literacy_score) AS INT) AS financial_literacy_score, CAST(coalesce(e.es, p.employability_skills_score) AS INT) AS employability_skills_score,
  CAST(coalesce(e.cr, p.confidence_resilience_score) AS INT) AS confidence_resilience_score, CAST(coalesce(e.os, p.online_safety_score) AS INT) AS online_safety_score,
  CASE WHEN e.es IS NOT NULL THEN 'employability_skills' ELSE p.top_curriculum END AS top_curriculum, CAST(coalesce(e.es, p.top_curriculum_score) AS INT) AS top_curriculum_score,
  p.top_finding_id, coalesce(e.sig, p.critical_signals) AS critical_signals, CASE WHEN e.es IS NOT NULL THEN 'critical' ELSE p.tier END AS tier,
  p.first_inspection_date, p.latest_inspection_date, p.last_inspection_id
  FROM (SELECT * FROM {{sc_inspected}} UNION ALL BY NAME SELECT * FROM {{sc_uninspected}}) p FULL JOIN {{sc_employers}} e ON e.institution_id = p.institution_id"""

_ALL = ", ".join(c if c != "critical_signals" else "array_to_string(critical_signals, ' · ') AS critical_signals" for c in sc.SCORE_COLUMNS)


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("critical_signals", F.array_join("critical_signals", " · "))


def base(v: Views) -> DataFrame:
    return sc.score_base(v.institutions, v.inspections, v.findings, v.matches, v.notices, v.news)


def mart_plan(v: Views) -> DataFrame:
    return sc.opportunity_scores(v.institutions, v.inspections, v.findings, v.matches, v.notices, v.news, AS_OF)


_marts: dict[tuple[str, str], DataFrame] = {}


def mart(v: Views) -> DataFrame:
    """The stored score table of a folder (written once per session, as the
    reports read a stored mart)."""
    key = (v.spark.sparkContext.applicationId, v.dir)
    if key not in _marts:
        _marts[key] = cut_lineage(mart_plan(v), "scores")
    return _marts[key]



@query("inspection_meta", "SELECT * FROM {sc_meta}")
def _(v: Views) -> DataFrame:
    return bags.inspection_meta(v.inspections)


@query("finding_bag", f"SELECT institution_id, {_per('round(<c>_total, 6) AS <c>_total')}, finding_count, top_finding_id FROM {{sc_fbag}}")
def _(v: Views) -> DataFrame:
    bag = bags.finding_bag(v.findings, v.matches)
    return bag.withColumns({f"{c}_total": F.round(f"{c}_total", 6) for c in CURRICULA})


@query("notice_bag", "SELECT institution_id, array_to_string(subjects, '|') AS subjects, notice_count, worst_severity FROM {sc_nbag}")
def _(v: Views) -> DataFrame:
    return bags.notice_bag(v.notices).select(
        "institution_id", F.array_join("top_notices.subject", "|").alias("subjects"), "notice_count", "worst_severity"
    )


@query(
    "news_bag",
    """SELECT institution_id, concat_ws('|', CAST(sev1 AS VARCHAR), CAST(sev2 AS VARCHAR), CAST(sev3 AS VARCHAR)) AS severities, head1 AS head,
       pub1 AS published_at FROM {sc_wbag}""",
)
def _(v: Views) -> DataFrame:
    top = F.get("top_news", F.lit(0))
    return bags.news_bag(v.news).select(
        "institution_id",
        F.array_join(F.transform("top_news", lambda n: n["severity"].cast("string")), "|").alias("severities"),
        F.coalesce(top["angle"], F.substring(top["title"], 1, 100)).alias("head"),
        top["published_at"].alias("published_at"),
    )


_STEPS = ["judgement_part", "finding_part", "sub_scores", "hard_floors", "explain_signals", "notice_floor", "news_boost", "synergy", "lead_curriculum"]


def after(v: Views, last: str) -> DataFrame:
    df = base(v).where(F.col("in_scope") & F.col("latest").isNotNull())
    df = df.withColumns({c: F.col(f"latest.{c}") for c in sc.LATEST if c != "id"})
    for step in _STEPS[: _STEPS.index(last) + 1]:
        df = getattr(sc, step)(df)
    return df


def _subs(df: DataFrame, *extra) -> DataFrame:
    return df.select("institution_id", *sc.SUB.values(), *extra)


def _sig():
    return F.array_join("signals", " · ").alias("signals")


def _stage(n: int, table: str, *extra: str) -> str:
    return f"SELECT institution_id, {_per(f'<s>{n} AS <c>_score')}{''.join(', ' + e for e in extra)} FROM {{{table}}}"


@query("judgement_part", f"SELECT institution_id, {_per('round(<c>_judgement, 6) AS <c>_judgement')} FROM {{sc_parts}}")
def _(v: Views) -> DataFrame:
    df = after(v, "judgement_part")
    return df.select("institution_id", *[F.round(f"{c}_judgement", 6).alias(f"{c}_judgement") for c in CURRICULA])


@query(
    "judgement_weights",
    "SELECT framework, curriculum, CAST(count(*) AS BIGINT) AS weak_grades, round(sum(points), 4) AS points FROM ("
    + " UNION ALL ".join(
        f"SELECT '{fw}' AS framework, '{c}' AS curriculum, CAST({_u(f)} AS DOUBLE) * {w[i]} * 35 AS points FROM (SELECT n.*, t.type FROM {{inspections}} n JOIN {{institutions}} t ON t.id = n.institution_id) x "
        f"WHERE {_FRAME} = '{fw}' AND {_u(f)} > 0"
        for fw, fields in expected.JUDGEMENT_WEIGHTS.items()
        for f, _, w in fields
        for i, c in enumerate(CURRICULA)
    )
    + ") z GROUP BY 1, 2",
)
def _(v: Views) -> DataFrame:
    """Every weak grade of every inspection against the weight table."""
    fields = [f for f in sc.LATEST if f not in ("id", "inspection_body")]
    typed = v.inspections.join(v.institutions.select(F.col("id").alias("institution_id"), "type"), "institution_id")
    long = typed.select(
        sc.weight_framework(F.col("inspection_body"), F.col("type")).alias("framework"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), sc._urgency(f).alias("urgency")) for f in fields])),
    ).where(F.col("urgency") > 0)
    weights = sc.judgement_weights(v.spark)
    joined = long.join(weights, ["framework", "field"])
    return joined.groupBy("framework", "curriculum").agg(
        F.count(F.lit(1)).alias("weak_grades"), F.round(F.sum(F.col("urgency") * F.col("weight") * 35), 4).alias("points")
    )


@query("finding_part", f"SELECT institution_id, {_per('round(<c>_finding, 6) AS <c>_finding')} FROM {{sc_parts}}")
def _(v: Views) -> DataFrame:
    df = after(v, "finding_part")
    return df.select("institution_id", *[F.round(f"{c}_finding", 6).alias(f"{c}_finding") for c in CURRICULA])


@query("sub_scores", _stage(0, "sc_sub"))
def _(v: Views) -> DataFrame:
    return _subs(after(v, "sub_scores"))


@query("hard_floors", _stage(1, "sc_floor", "array_to_string(sig1, ' · ') AS signals", "CAST(crit1 AS INT) AS critical_count"))
def _(v: Views) -> DataFrame:
    return _subs(after(v, "hard_floors"), _sig(), "critical_count")


@query("explain_signals", "SELECT institution_id, array_to_string(sig2, ' · ') AS signals FROM {sc_explained}")
def _(v: Views) -> DataFrame:
    return after(v, "explain_signals").select("institution_id", _sig())


@query("notice_floor", _stage(2, "sc_noticed", "array_to_string(sig3, ' · ') AS signals", "CAST(crit2 AS INT) AS critical_count"))
def _(v: Views) -> DataFrame:
    return _subs(after(v, "notice_floor"), _sig(), "critical_count")


@query("news_boost", _stage(3, "sc_boosted", "array_to_string(sig4, ' · ') AS signals", "CAST(crit3 AS INT) AS critical_count"))
def _(v: Views) -> DataFrame:
    return _subs(after(v, "news_boost"), _sig(), "critical_count")


@query("synergy", _stage(4, "sc_synergy", "array_to_string(sig5, ' · ') AS signals"))
def _(v: Views) -> DataFrame:
    return _subs(after(v, "synergy"), _sig())


@query("lead_curriculum", "SELECT institution_id, lead AS top_curriculum, CAST(urgency AS INT) AS top_curriculum_score FROM {sc_led}")
def _(v: Views) -> DataFrame:
    return after(v, "lead_curriculum").select("institution_id", "top_curriculum", "top_curriculum_score")


@query(
    "pipeline_value",
    f"SELECT institution_id, CAST({_PV} AS INT) AS pipeline_value_score, array_to_string({_PSIG}, ' · ') AS pipeline_signals FROM {{sc_base}}",
)
def _(v: Views) -> DataFrame:
    return sc.pipeline_value(base(v), AS_OF).select(
        "institution_id", "pipeline_value_score", F.array_join("pipeline_signals", " · ").alias("pipeline_signals")
    )


@query(
    "headline_and_tier",
    f"""SELECT id, CAST(least(greatest({_CEIL}, u), greatest(u, p)) AS INT) AS headline, {_tier('u', 'p')} AS tier
        FROM (SELECT id, overall_grade, CAST(id % 101 AS INT) AS u, CAST((id * 7) % 101 AS INT) AS p FROM {{inspections}}) x""",
)
def _(v: Views) -> DataFrame:
    u, p = (F.col("id") % 101).cast("int"), (F.col("id") * 7 % 101).cast("int")
    return v.inspections.select("id", sc.headline(u, p, F.col("overall_grade")).alias("headline"), sc.tier(u, p).alias("tier"))


@query("score_inspected", f"SELECT {_ALL} FROM {{sc_inspected}}")
def _(v: Views) -> DataFrame:
    return flat(sc.score_inspected(base(v), AS_OF))


@query("score_uninspected", f"SELECT {_ALL} FROM {{sc_uninspected}}")
def _(v: Views) -> DataFrame:
    return flat(sc.score_uninspected(base(v), AS_OF))


@query(
    "score_employers",
    "SELECT institution_id, CAST(es AS INT) AS score, CAST(fl + es + cr + os AS INT) AS raw_score, array_to_string(sig, ' · ') AS critical_signals FROM {sc_employers}",
)
def _(v: Views) -> DataFrame:
    return flat(sc.score_employers(v.institutions)).select("institution_id", "score", "raw_score", "critical_signals")


@query("opportunity_scores", f"SELECT {_ALL} FROM {{scores}}")
def _(v: Views) -> DataFrame:
    return flat(mart_plan(v))
